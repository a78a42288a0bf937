"""Word lists, term tables and patterns.

Everything here has to read exactly as it does for results to be right; the
lists are kept in natural order.
"""

from __future__ import annotations

# ----------------------------------------------------------- query analysis

FACTUAL = ("what is", "who is", "when did", "where is", "define", "definition", "meaning")
PROCEDURAL = ("how to", "steps", "process", "procedure", "method", "way to", "guide", "tutorial")
COMPARATIVE = ("compare", "versus", "vs", "difference", "better", "worse", "similar", "unlike")
TEMPORAL = ("history", "timeline", "evolution", "trend", "recent", "latest", "current", "future")
NUMERICAL = ("number", "count", "statistics", "percentage", "rate", "measure")
CONJUNCTIONS = ("and", "or", "but", "however", "therefore", "because")
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "can", "this", "that", "these", "those",
)
SEMANTIC_WORDS = (
    "concept", "idea", "theory", "principle", "approach", "method", "understand", "explain", "analyze",
    "evaluate", "compare", "relationship", "connection", "impact", "effect", "influence",
)

SERVICE_DEFINITION = ("什么是", "定义")
SERVICE_SYMPTOM = ("症状", "表现")
SERVICE_TREATMENT = ("治疗", "药物")
SERVICE_QUESTION = ("？", "?", "什么", "如何")
SERVICE_STOP_WORDS = ("的", "了", "在", "是", "有", "和", "或", "a", "an", "the")
SUGGESTION_SUFFIXES = ("的症状", "的治疗方法", "的诊断标准", "的预防措施")

# -------------------------------------------------------- query transformation

QUERY_SYNONYMS = {
    "高血压": ("高血压病", "原发性高血压", "继发性高血压"),
    "糖尿病": ("DM", "diabetes", "血糖异常"),
    "心脏病": ("心血管疾病", "冠心病", "心肌梗死"),
    "癌症": ("肿瘤", "恶性肿瘤", "癌", "carcinoma"),
    "感冒": ("上呼吸道感染", "感冒症状", "流感"),
    "发烧": ("发热", "体温升高", "高热"),
    "头痛": ("头疼", "偏头痛", "头部疼痛"),
    "咳嗽": ("咳痰", "干咳", "咳嗽症状"),
}
QUERY_EXPANSIONS = {
    "症状": ("临床表现", "体征", "病症"),
    "治疗": ("疗法", "治疗方案", "医治"),
    "药物": ("药品", "medication", "处方药"),
    "诊断": ("确诊", "诊断标准", "鉴别诊断"),
    "预防": ("预防措施", "预防方法", "防护"),
}
QUESTION_MARKS = ("什么", "如何", "为什么", "怎么", "？", "?")
STATEMENT_VARIANTS = ("什么是{}", "{}是什么", "如何{}", "{}的症状", "{}的治疗方法")
DEFINITION_VARIANTS = ("{}", "{}定义", "{}概念")
HOWTO_VARIANTS = ("{}方法", "{}步骤", "{}指南")
REWRITE_STOP_WORDS = ("的", "了", "在", "是", "有", "和", "或", "但是", "然而", "因为", "所以")
REWRITE_TERMS = {"高血压病": "高血压", "糖尿病患者": "糖尿病", "心脏疾病": "心脏病", "恶性肿瘤": "癌症"}
QUERY_ENTITIES = {
    "diseases": ("高血压", "糖尿病", "心脏病", "癌症", "感冒", "肺炎"),
    "symptoms": ("发烧", "头痛", "咳嗽", "胸痛", "呼吸困难"),
    "treatments": ("手术", "化疗", "放疗", "药物治疗", "物理治疗"),
    "medications": ("阿司匹林", "青霉素", "胰岛素", "降压药"),
}

# ------------------------------------------------------------- text quality

RELEVANCE_GROUPS = {
    "disease": ("疾病", "病症", "症状", "综合征", "病理", "诊断", "治疗", "药物", "手术"),
    "anatomy": ("心脏", "肺部", "肝脏", "肾脏", "大脑", "血管", "神经", "肌肉", "骨骼"),
    "medical_terms": ("患者", "病人", "医生", "护士", "医院", "临床", "检查", "化验", "影像"),
    "procedures": ("手术", "检查", "治疗", "护理", "康复", "预防", "筛查", "监测"),
    "medications": ("药物", "药品", "剂量", "副作用", "禁忌", "适应症", "处方"),
}
CONTENT_TYPES = (
    ("medical_report", ("诊断", "症状", "治疗", "病史", "检查结果")),
    ("research_paper", ("摘要", "方法", "结果", "结论", "参考文献")),
    ("clinical_guideline", ("指南", "建议", "推荐", "标准", "规范")),
)
EVALUATOR_TERMS = (
    "症状", "诊断", "治疗", "药物", "手术", "检查", "化验", "病理",
    "临床", "病史", "体征", "疾病", "综合征", "并发症", "预后", "康复",
    "心脏", "肺部", "肝脏", "肾脏", "大脑", "血管", "神经", "肌肉",
    "骨骼", "关节", "皮肤", "眼部", "耳鼻喉", "消化道", "呼吸道",
    "高血压", "糖尿病", "冠心病", "脑梗塞", "肺炎", "肝炎", "肾炎",
    "胃炎", "肠炎", "关节炎", "骨折", "肿瘤", "癌症", "白血病",
    "血常规", "尿常规", "肝功能", "肾功能", "心电图", "胸片", "CT",
    "MRI", "B超", "内镜", "病理检查", "基因检测", "免疫检查",
    "抗生素", "激素", "降压药", "降糖药", "止痛药", "抗炎药",
    "抗凝药", "利尿剂", "镇静剂", "维生素", "中药", "西药",
)
EVALUATOR_STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人",
    "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去",
    "你", "会", "着", "没有", "看", "好", "自己", "这", "那", "里",
    "患者", "病人", "例", "岁", "男性", "女性", "主诉", "现病史",
)

# -------------------------------------------------------------------- cleaning

FULL_WIDTH_LETTERS = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
HALF_WIDTH_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FULL_WIDTH_DIGITS = "０１２３４５６７８９"
HALF_WIDTH_DIGITS = "0123456789"
HEADER_PATTERNS = (
    r"·\s*标\s*准\s*与\s*规\s*范\s*·",
    r"·\s*指南与共识\s*·",
    r"·\s*综\s*述\s*·",
    r"·\s*论\s*著\s*·",
    r"临床心血管病杂志",
    r"中华医学杂志",
    r"中国医学科学院",
    r"执笔者[:：]",
    r"通信作者[:：]",
    r"作者单位[:：]",
    r"基金项目[:：]",
    r"收稿日期[:：]",
    r"修回日期[:：]",
    r"接受日期[:：]",
    r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    r"Vol\.\s*\d+",
    r"No\.\s*\d+",
    r"\d+年第\d+期",
)
CLEANER_ABBREVIATIONS = {
    "MI": "心肌梗死", "AMI": "急性心肌梗死", "CAD": "冠心病", "CHD": "冠心病", "HF": "心力衰竭",
    "AF": "心房颤动", "HTN": "高血压", "DM": "糖尿病", "COPD": "慢性阻塞性肺疾病", "CKD": "慢性肾脏病",
    "PCI": "经皮冠状动脉介入治疗", "CABG": "冠状动脉旁路移植术", "ECG": "心电图", "EKG": "心电图",
    "ECHO": "超声心动图", "CT": "计算机断层扫描", "MRI": "磁共振成像", "ICU": "重症监护室",
    "CCU": "冠心病监护室", "ER": "急诊科", "ED": "急诊科",
    "心梗": "心肌梗死", "冠脉": "冠状动脉", "房颤": "心房颤动", "室颤": "心室颤动", "心衰": "心力衰竭",
    "高血压": "高血压", "糖尿病": "糖尿病",
}

# ----------------------------------------------------------------- terminology

STANDARD_TERMS = {
    "心肌梗塞": "心肌梗死", "心肌梗死症": "心肌梗死", "急性心梗": "急性心肌梗死", "急性MI": "急性心肌梗死",
    "冠状动脉疾病": "冠心病", "冠状动脉粥样硬化性心脏病": "冠心病", "冠状动脉硬化": "冠心病",
    "心房纤颤": "心房颤动", "房性纤颤": "心房颤动", "心室纤颤": "心室颤动", "室性纤颤": "心室颤动",
    "充血性心力衰竭": "心力衰竭", "心功能不全": "心力衰竭", "左心衰": "左心衰竭", "右心衰": "右心衰竭",
    "高血压病": "高血压", "原发性高血压": "高血压", "继发性高血压": "继发性高血压",
    "恶性高血压": "恶性高血压", "高血压危象": "高血压急症",
    "糖尿病": "糖尿病", "1型糖尿病": "1型糖尿病", "2型糖尿病": "2型糖尿病",
    "胰岛素依赖型糖尿病": "1型糖尿病", "非胰岛素依赖型糖尿病": "2型糖尿病",
    "妊娠糖尿病": "妊娠期糖尿病", "糖尿病酮症酸中毒": "糖尿病酮症酸中毒",
    "慢性阻塞性肺病": "慢性阻塞性肺疾病", "慢阻肺": "慢性阻塞性肺疾病", "支气管哮喘": "哮喘",
    "急性呼吸窘迫综合征": "急性呼吸窘迫综合征", "呼吸衰竭": "呼吸衰竭",
    "慢性肾脏疾病": "慢性肾脏病", "慢性肾功能不全": "慢性肾脏病", "急性肾损伤": "急性肾损伤",
    "急性肾衰竭": "急性肾损伤", "终末期肾病": "终末期肾脏病",
    "脑血管意外": "脑卒中", "中风": "脑卒中", "脑梗塞": "脑梗死", "脑梗死": "脑梗死", "脑出血": "脑出血",
    "蛛网膜下腔出血": "蛛网膜下腔出血", "短暂性脑缺血发作": "短暂性脑缺血发作",
    "恶性肿瘤": "恶性肿瘤", "癌症": "恶性肿瘤", "肺癌": "肺癌", "乳腺癌": "乳腺癌", "胃癌": "胃癌",
    "肝癌": "肝癌", "结直肠癌": "结直肠癌",
    "新型冠状病毒肺炎": "COVID-19", "新冠肺炎": "COVID-19", "获得性免疫缺陷综合征": "艾滋病",
    "艾滋病": "艾滋病", "肺结核": "肺结核", "结核病": "结核病",
}
ABBREVIATIONS = {
    "MI": "心肌梗死", "AMI": "急性心肌梗死", "STEMI": "ST段抬高型心肌梗死", "NSTEMI": "非ST段抬高型心肌梗死",
    "CAD": "冠心病", "CHD": "冠心病", "IHD": "缺血性心脏病", "HF": "心力衰竭", "CHF": "充血性心力衰竭",
    "AF": "心房颤动", "VF": "心室颤动", "VT": "室性心动过速", "SVT": "室上性心动过速", "HTN": "高血压",
    "DM": "糖尿病", "T1DM": "1型糖尿病", "T2DM": "2型糖尿病", "COPD": "慢性阻塞性肺疾病",
    "ARDS": "急性呼吸窘迫综合征", "CKD": "慢性肾脏病", "AKI": "急性肾损伤", "ESRD": "终末期肾脏病",
    "CVA": "脑血管意外", "TIA": "短暂性脑缺血发作", "ICH": "脑出血", "SAH": "蛛网膜下腔出血",
    "PE": "肺栓塞", "DVT": "深静脉血栓", "UTI": "尿路感染",
    "PCI": "经皮冠状动脉介入治疗", "PTCA": "经皮冠状动脉腔内成形术", "CABG": "冠状动脉旁路移植术",
    "IABP": "主动脉内球囊反搏", "ECMO": "体外膜肺氧合", "CPR": "心肺复苏", "ACLS": "高级心脏生命支持",
    "BLS": "基础生命支持",
    "ECG": "心电图", "EKG": "心电图", "ECHO": "超声心动图", "TTE": "经胸超声心动图", "TEE": "经食管超声心动图",
    "CT": "计算机断层扫描", "MRI": "磁共振成像", "PET": "正电子发射断层扫描", "SPECT": "单光子发射计算机断层扫描",
    "DSA": "数字减影血管造影", "CAG": "冠状动脉造影", "IVUS": "血管内超声", "OCT": "光学相干断层扫描",
    "FFR": "血流储备分数",
    "CBC": "全血细胞计数", "BUN": "血尿素氮", "Cr": "肌酐", "eGFR": "估算肾小球滤过率",
    "ALT": "丙氨酸氨基转移酶", "AST": "天冬氨酸氨基转移酶", "CK": "肌酸激酶", "CK-MB": "肌酸激酶同工酶",
    "cTnI": "心肌肌钙蛋白I", "cTnT": "心肌肌钙蛋白T", "BNP": "脑钠肽", "NT-proBNP": "N末端脑钠肽前体",
    "CRP": "C反应蛋白", "ESR": "红细胞沉降率", "PCT": "降钙素原", "HbA1c": "糖化血红蛋白",
    "LDL": "低密度脂蛋白", "HDL": "高密度脂蛋白", "TC": "总胆固醇", "TG": "甘油三酯",
    "ICU": "重症监护室", "CCU": "冠心病监护室", "CICU": "心脏重症监护室", "NICU": "新生儿重症监护室",
    "PICU": "儿科重症监护室", "ER": "急诊科", "ED": "急诊科", "OR": "手术室", "PACU": "麻醉后恢复室",
    "心梗": "心肌梗死", "急性心梗": "急性心肌梗死", "冠脉": "冠状动脉", "房颤": "心房颤动", "室颤": "心室颤动",
    "心衰": "心力衰竭", "高血压": "高血压", "糖尿病": "糖尿病", "慢阻肺": "慢性阻塞性肺疾病",
    "慢性肾病": "慢性肾脏病", "脑梗": "脑梗死", "脑出血": "脑出血",
}
SYNONYMS = {
    "心肌梗死": ("心肌梗塞", "心梗", "MI", "AMI"),
    "冠心病": ("冠状动脉疾病", "CAD", "CHD", "冠状动脉粥样硬化性心脏病"),
    "心房颤动": ("房颤", "AF", "心房纤颤"),
    "心力衰竭": ("心衰", "HF", "CHF", "心功能不全"),
    "高血压": ("HTN", "高血压病"),
    "糖尿病": ("DM", "diabetes"),
    "慢性阻塞性肺疾病": ("COPD", "慢阻肺", "慢性阻塞性肺病"),
    "慢性肾脏病": ("CKD", "慢性肾病", "慢性肾功能不全"),
    "脑卒中": ("中风", "CVA", "脑血管意外"),
    "脑梗死": ("脑梗塞", "脑梗", "缺血性脑卒中"),
}
DRUGS = (
    "阿司匹林", "氯吡格雷", "替格瑞洛", "阿托伐他汀", "瑞舒伐他汀", "美托洛尔", "比索洛尔", "卡维地洛",
    "依那普利", "贝那普利", "缬沙坦", "氨氯地平", "硝苯地平", "螺内酯", "呋塞米", "氢氯噻嗪", "华法林",
    "达比加群", "利伐沙班", "阿哌沙班",
    "二甲双胍", "格列齐特", "格列美脲", "瑞格列奈", "阿卡波糖", "西格列汀", "利拉鲁肽", "胰岛素",
    "青霉素", "阿莫西林", "头孢曲松", "左氧氟沙星", "阿奇霉素", "万古霉素",
)
DISEASES = (
    "肺炎", "支气管炎", "胃炎", "肝炎", "肾炎", "关节炎", "骨折", "贫血", "白血病", "淋巴瘤",
)
PROCEDURES = (
    "经皮冠状动脉介入治疗", "冠状动脉旁路移植术", "心脏起搏器植入术", "心脏除颤器植入术", "心脏瓣膜置换术",
    "心脏瓣膜修复术", "主动脉内球囊反搏", "体外膜肺氧合", "血液透析", "腹膜透析", "肾移植", "肝移植",
    "心脏移植",
)

# -------------------------------------------------------------------- elements

TITLE_DOCUMENT = ("指南", "共识", "标准", "规范", "建议")
TITLE_SECTION = ("摘要", "abstract", "背景", "目的")
NARRATIVE_AUTHOR = ("作者", "author", "通信", "corresponding")
NARRATIVE_KEYWORDS = ("关键词", "keywords", "key words")
FILE_KINDS = (
    ("medical_report", ("report", "报告")),
    ("clinical_guideline", ("guideline", "指南")),
    ("research_paper", ("paper", "论文")),
)
MIME_TYPES = {
    ".pdf": ("application/pdf",),
    ".docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",),
    ".pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation",),
    ".xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",),
    ".txt": ("text/plain",),
    ".md": ("text/markdown", "text/plain"),
}
