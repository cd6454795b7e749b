"""Word lists, lookup tables, labels and patterns that decide results."""

# Countries, canonical key -> (name, short form).
COUNTRIES = {
    "US": ("United States", "US"), "Japan": ("Japan", "Japan"), "China": ("China", "China"),
    "Germany": ("Germany", "Germany"), "United Kingdom": ("United Kingdom", "UK"), "Italy": ("Italy", "Italy"),
    "Spain": ("Spain", "Spain"), "Korea": ("South Korea", "South Korea"), "Canada": ("Canada", "Canada"),
    "Mexico": ("Mexico", "Mexico"), "Poland": ("Poland", "Poland"), "Austria": ("Austria", "Austria"),
    "Belgium": ("Belgium", "Belgium"), "Bulgaria": ("Bulgaria", "Bulgaria"), "Croatia": ("Croatia", "Croatia"),
    "Cyprus": ("Cyprus", "Cyprus"), "Czech Republic": ("Czech Republic", "Czech Republic"),
    "Denmark": ("Denmark", "Denmark"), "Estonia": ("Estonia", "Estonia"), "Finland": ("Finland", "Finland"),
    "France": ("France", "France"), "Greece": ("Greece", "Greece"), "Hungary": ("Hungary", "Hungary"),
    "Ireland": ("Ireland", "Ireland"), "Latvia": ("Latvia", "Latvia"), "Lithuania": ("Lithuania", "Lithuania"),
    "Luxembourg": ("Luxembourg", "Luxembourg"), "Malta": ("Malta", "Malta"), "Netherlands": ("Netherlands", "Netherlands"),
    "Portugal": ("Portugal", "Portugal"), "Romania": ("Romania", "Romania"), "Slovakia": ("Slovakia", "Slovakia"),
    "Slovenia": ("Slovenia", "Slovenia"), "Sweden": ("Sweden", "Sweden"), "Norway": ("Norway", "Norway"),
    "Australia": ("Australia", "Australia"), "Brazil": ("Brazil", "Brazil"), "India": ("India", "India"),
    "Switzerland": ("Switzerland", "Switzerland"), "Russia": ("Russia", "Russia"), "Turkey": ("Turkey", "Turkey"),
    "Argentina": ("Argentina", "Argentina"), "South Africa": ("South Africa", "South Africa"),
}

# Spellings of each country, by canonical key.
ALIASES = {
    "US": ["US", "USA", "U.S.", "United States"], "Japan": ["Japan", "JP"], "China": ["China", "CN"],
    "Germany": ["Germany", "DE"], "United Kingdom": ["United Kingdom", "UK", "GB"], "Italy": ["Italy", "IT"],
    "Spain": ["Spain", "ES"], "Korea": ["Korea", "South Korea", "S. Korea", "KR"], "Canada": ["Canada", "CA"],
    "Mexico": ["Mexico", "MX"], "Poland": ["Poland", "PL"], "Austria": ["Austria", "AT"], "Belgium": ["Belgium", "BE"],
    "Bulgaria": ["Bulgaria", "BG"], "Croatia": ["Croatia", "HR"], "Cyprus": ["Cyprus", "CY"],
    "Czech Republic": ["Czech Republic", "CZ", "Czechia"], "Denmark": ["Denmark", "DK"], "Estonia": ["Estonia", "EE"],
    "Finland": ["Finland", "FI"], "France": ["France", "FR"], "Greece": ["Greece", "GR"], "Hungary": ["Hungary", "HU"],
    "Ireland": ["Ireland", "IE"], "Latvia": ["Latvia", "LV"], "Lithuania": ["Lithuania", "LT"],
    "Luxembourg": ["Luxembourg", "LU"], "Malta": ["Malta", "MT"], "Netherlands": ["Netherlands", "NL", "Holland"],
    "Portugal": ["Portugal", "PT"], "Romania": ["Romania", "RO"], "Slovakia": ["Slovakia", "SK"],
    "Slovenia": ["Slovenia", "SI"], "Sweden": ["Sweden", "SE"], "Norway": ["Norway", "NO"], "Australia": ["Australia", "AU"],
    "Brazil": ["Brazil", "BR"], "India": ["India", "IN"], "Switzerland": ["Switzerland", "CH"], "Russia": ["Russia", "RU"],
    "Turkey": ["Turkey", "TR"], "Argentina": ["Argentina", "AR"], "South Africa": ["South Africa", "ZA"],
}

# Languages by country short form.
COUNTRY_LANGUAGES = {
    "US": ["English"], "Canada": ["English", "French"], "Mexico": ["Spanish (Latin America)"],
    "Argentina": ["Spanish (Latin America)"], "Brazil": ["Portuguese (Brazil)"], "UK": ["English"], "Ireland": ["English"],
    "Germany": ["German"], "Austria": ["German"], "Switzerland": ["Swiss German", "French", "Italian"], "France": ["French"],
    "Belgium": ["Dutch", "French"], "Luxembourg": ["French", "German"], "Netherlands": ["Dutch"], "Italy": ["Italian"],
    "Spain": ["Spanish (EU)"], "Portugal": ["Portuguese (EU)"], "Greece": ["Greek"], "Malta": ["English"], "Cyprus": ["Greek"],
    "Denmark": ["Danish"], "Sweden": ["Swedish"], "Finland": ["Finnish"], "Norway": ["Norwegian"], "Estonia": ["Estonian"],
    "Latvia": ["Latvian"], "Lithuania": ["Lithuanian"], "Poland": ["Polish"], "Czech Republic": ["Czech"],
    "Slovakia": ["Slovakian"], "Hungary": ["Hungarian"], "Romania": ["Romanian"], "Bulgaria": ["Bulgarian"],
    "Croatia": ["Croatian"], "Slovenia": ["Slovenian"], "Turkey": ["Turkish"], "Russia": ["Russian"], "Japan": ["Japanese"],
    "China": ["Chinese"], "South Korea": ["Korean"], "India": ["Hindi", "English"], "Australia": ["English"],
    "South Africa": ["Afrikaans", "English"],
}

# Names of translation languages, in report order.
LANGUAGES = [
    "English", "French", "German", "Italian", "Japanese", "Portuguese", "Chinese", "Spanish", "Afrikaans", "Arabic",
    "Belarusian", "Bulgarian", "Croatian", "Czech", "Danish", "Dutch", "Estonian", "Finnish", "Georgian", "Greek", "Hebrew",
    "Hindi", "Hungarian", "Indonesian", "Korean", "Latvian", "Lithuanian", "Malay", "Norwegian", "Polish", "Romanian",
    "Russian", "Serbian", "Slovakian", "Slovenian", "Swedish", "Thai", "Taiwanese", "Turkish", "Ukrainian",
]

# Disease keyword -> area; the first keyword in this order decides.
AREA_KEYWORDS = [
    ("oncolog", "Oncology"), ("cancer", "Oncology"), ("tumor", "Oncology"), ("tumour", "Oncology"),
    ("breast", "Oncology - Breast Cancer"), ("lung", "Oncology - Lung Cancer"), ("melanoma", "Oncology"),
    ("lymphoma", "Oncology"), ("leukemia", "Oncology"), ("pain", "Neuroscience - Pain"), ("neuropath", "Neuroscience - Pain"),
    ("migraine", "Neuroscience - Pain"), ("fibromyalgia", "Neuroscience - Pain"), ("alzheimer", "Neuroscience"),
    ("dementia", "Neuroscience"), ("parkinson", "Neuroscience"), ("schizophreni", "Neuroscience"),
    ("depression", "Neuroscience"), ("bipolar", "Neuroscience"), ("diabetes", "Diabetes/Endocrinology"),
    ("diabetic", "Diabetes/Endocrinology"), ("obesity", "Diabetes/Endocrinology"), ("weight", "Diabetes/Endocrinology"),
    ("cardiovascular", "Cardiovascular"), ("heart failure", "Cardiovascular"), ("atherosclerosis", "Cardiovascular"),
    ("rheumatoid", "Immunology"), ("psoriasis", "Immunology"), ("atopic dermatitis", "Immunology"), ("lupus", "Immunology"),
    ("crohn", "Immunology"), ("colitis", "Immunology"), ("asthma", "Immunology"), ("eczema", "Immunology"),
]

# Table headers that are not visits.
NON_VISIT_HEADERS = [
    "rt", "retest", "comments", "comment", "notes", "note", "visit number", "visit #", "visit", "study day", "day",
    "visit type", "visit label", "study week", "study month", "study period", "period", "time point", "timepoint",
    "window", "allowable window", "assessment",
]

# One visit or timepoint word in a table header.
VISIT_TOKEN = (
    r"\d+|[Vv](?:isit)?\.?\s*\d+[a-z]?|scr(?:een(?:ing)?)?|ed|edu|eos|et|fu|"
    r"(?:day|week|month|cycle|year)s?\s*\d+(?:\s*[-–]\s*\d+)?[a-z]?|predose|pre[\s-]*dose|postdose|post[\s-]*dose|"
    r"(?:hour|hr|h)\s*\d+[a-z]?|\d{1,2}\s*(?:h|hr|hour)s?|(?:trough|peak|random|infusion|follow[\s-]*up|safety[\s-]*fu)"
)

# Nouns that end a divider row's label.
DIVIDER_ENDING = (
    r"(?i)(?:assessments?|evaluations?|procedures?|parameters?|measurements?|examinations?|tests?\b|endpoints?|"
    r"observations?|monitoring|collections?|samples?|specimens?|determinations?|training|education|activit(?:y|ies))\s*$"
)

# Procedures that are not laboratory work.
NON_LAB = [
    r"(?:ecg|ekg)(?:\s*\(\d+\s*-?\s*lead\))?", r"electrocardiogram", r"holter(?:\s*monitor)?", r"telemetry",
    r"echocardiogram", r"cardiac\s*echo", r"vital\s*signs?", r"blood\s*pressure", r"heart\s*rate",
    r"pulse(?:\s*rate|\s*oximetry)?", r"temperature(?!.*(?:lab|serum|plasma|blood|sample|specimen))",
    r"respirat(?:ory\s*rate|ion)", r"(?:oxygen\s*)?saturation", r"spo2\b", r"pulse\s*oximetry",
    r"orthostatic\s*(?:vital|bp|blood)", r"\bheight\b(?!.*(?:lab|sample|specimen))", r"body\s*weight", r"body\s*mass",
    r"bmi\b(?!.*(?:calc|measur))", r"waist\s*circumference", r"body\s*surface\s*area", r"bsa\b", r"body\s*composition",
    r"physical\s*exam", r"clinical\s*exam", r"pulmonary\s*function", r"spirometr", r"pft\b", r"lung\s*function",
    r"neurologic\s*(?:exam|assessment|test|eval)", r"ophthalmolog", r"visual\s*acuit", r"fundoscop", r"slit\s*lamp",
    r"intraocular\s*pressure", r"iop\b", r"visual\s*field", r"audiometr", r"hearing\s*(?:test|exam|assessment)",
    r"bone\s*(?:density|scan|densitometry)", r"dexa\b", r"dxa\b", r"ecog\b", r"karnofsky", r"performance\s*status", r"kps\b",
    r"quality\s*of\s*life", r"qol\b", r"eq[\s-]?5d", r"eq5d", r"sf[\s-]?(?:36|12|8)\b",
    r"pain\s*(?:scale|score|questionnaire|inventory|diary|assess)", r"visual\s*analog\s*(?:scale)?", r"vas\b(?!cular)",
    r"likert\b", r"numeric\s*rating", r"nrs\b", r"phq[\s-]?[0-9]", r"gad[\s-]?[0-9]", r"hads\b", r"c[\s-]?ssrs",
    r"columbia[\s-]*suicid", r"ham[\s-]?[ad]\b", r"madrs\b", r"panss\b", r"ymrs\b", r"beck\s*depression", r"bdi\b",
    r"patient\s*health\s*questionnaire", r"questionnaire", r"patient[\s-]reported(?:.?outcome)?",
    r"pro\b(?!.*(?:lactin|gester|tein|tease|lifera|phyla|lapse|nounce|secut))", r"(?:patient|subject|symptom)\s*diary",
    r"adverse\s*event", r"ae\b", r"serious\s*adverse", r"sae\b", r"concomitant\s*med", r"con\s*med", r"prior\s*med",
    r"concomitant\s*therapy", r"medical\s*history", r"past\s*medical", r"demographic", r"smoking", r"tobacco",
    r"alcohol\s*use", r"substance\s*use", r"x[\s-]?ray", r"cxr\b", r"chest\s*(?:xray|radiograph)", r"ct\s*scan",
    r"cat\s*scan", r"computed\s*tomograph", r"mri\b", r"magnetic\s*resonance", r"ultrasound", r"sonogram",
    r"ultrasonograph", r"pet\s*scan", r"positron\s*emission", r"mammogram", r"mammograph",
    r"nuclear\s*(?:imaging|scan|medicine)", r"tumor\s*(?:assess|evaluat|measur|response)",
    r"disease\s*(?:assess|evaluat|measur|response)", r"recist\b", r"lesion\s*(?:assess|measur|evaluat)", r"target\s*lesion",
    r"non[\s-]*target\s*lesion", r"endoscop", r"colonoscop", r"sigmoidoscop", r"bronchoscop", r"cystoscop", r"laparoscop",
    r"arthroscop", r"hysteroscop", r"egd\b", r"esophagogastroduodenoscop", r"dosing", r"dose\s*(?:admin|level)",
    r"treatment\s*admin", r"study\s*drug\s*(?:admin|dispens|accountab|prepar)", r"ip\s*(?:admin|dispens|accountab|prepar)",
    r"investigational\s*product", r"drug\s*accountability", r"randomiz", r"random\s*assign", r"informed\s*consent",
    r"consent\b", r"icf\b", r"eligibility", r"screen\s*fail", r"inclusion", r"exclusion", r"i/e\s*criteria",
    r"survival\s*(?:follow|status|contact)", r"death\s*(?:confirm|report|assess)", r"end\s*of\s*study", r"eos\b",
    r"early\s*termination", r"study\s*close[\s-]*out", r"follow[\s-]*up(?!.*(?:sample|specimen|blood|urine|stool|tissue|csf))",
    r"protocol\s*deviation", r"(?:chest|breast|heart|lung)\s*auscult", r"reflex\b",
    r"motor\s*(?:exam|function|strength|assess)", r"dental\s*exam", r"oral\s*exam", r"eeg\b", r"electroencephalogram",
    r"emg\b", r"electromyogram", r"nerve\s*conduction", r"cognitive\s*(?:assess|test|exam|eval|function)",
    r"(?:mmse|moca|mini[\s-]*mental|montreal\s*cognitive)\b", r"(?:exercise|cardiac)\s*stress\s*test", r"muga\b",
    r"(?:elective|scheduled|unscheduled|interim)\s*(?:visit|contact|call|phone)",
    r"safety\s*(?:monitor|report|update|assessment|review|follow[\s-]*up)", r"\s(?:medication|treatment)\s*compliance",
    r"adherence\b", r"pill\s*count",
]

# Schedule rows to leave out, unless one of the keep patterns also matches.
DROP_ROWS = [
    r"\bIWRS\b", r"\bIVRS\b", r"register visit", r"randomi[sz]ation", r"randomi[sz]e", r"dispense", r"returns?\s+unused",
    r"study intervention compliance", r"administer study intervention", r"observe participant", r"injection training",
    r"injection diary", r"kwikpen", r"demo device", r"ancillary supplies", r"dosing (diary|report)", r"visit detail",
    r"visit number", r"visit interval", r"weeks from", r"^weeks$", r"^table \d+", r"^\(electronic\)$", r"informed consent",
    r"inclusion.{0,4}exclusion", r"confirmation of eligibility", r"eligibility", r"demographics", r"\bmedical history\b",
    r"preexisting condition", r"pre-existing condition", r"prior treatments? for indication", r"surgical history",
    r"family history", r"education level", r"substance use", r"prespecified.{0,20}history", r"vital signs", r"physical exam",
    r"physical assessment", r"\bheight\b", r"\bweight\b", r"waist circumference", r"hip circumference", r"\bBMI\b", r"\bABI\b",
    r"\b6-?MWT\b", r"12-?lead ECG", r"\bECG\b", r"electrocardiogram", r"\bDXA\b", r"fundus photograph", r"MRI of spine",
    r"treadmill", r"clinician assessment of sensory", r"symptom-directed", r"lifestyle counsel", r"diet and physical activity",
    r"nutrition and physical activity", r"treatment goal", r"medication (washout|intensity)", r"antihypertensive", r"diary",
    r"\bdBM\b", r"digital biomarker device", r"EQ-5D", r"PHQ-9", r"C-SSRS", r"NRS\b", r"\bPGI-?[CS]", r"PGI-Stat", r"PROMIS",
    r"SF-?36", r"IWQOL", r"WPAI", r"WPI-", r"API-", r"RMDQ", r"\bDN4\b", r"\bNPSI\b", r"\bPCS\b", r"\bCoEQ\b", r"\bFNQ\b",
    r"VascuQoL", r"\bVAS\b", r"body map", r"pain interference", r"pain catastrophizing", r"global impression",
    r"mental health", r"patient-?reported", r"rescue medication", r"pain (concomitant )?med", r"concomitant medication",
    r"adverse event", r"\bAEs?\b", r"endpoint event", r"participant education",
]
KEEP_ROWS = [
    r"\bPK\b", r"pharmacokinetic", r"immunogenicity", r"\bADA\b", r"genetics? sample", r"epigenetics", r"biomarker",
    r"pregnancy (test|—|-)?.{0,10}(serum|blood)", r"serum pregnancy", r"\bsample\b", r"specimen", r"\bassay\b", r"\bblood\b",
    r"\bserum\b", r"urinalysis", r"urine drug screen", r"hematology|haematology", r"clinical chemistry",
    r"lipid|glucose|insulin|hba1c|egfr|tsh|fsh|calcitonin|amylase|lipase|creatinine",
]

# Running page text that is not content.
PAGE_NOISE = [
    r"^(?:#\s*)?(?:CONFIDENTIAL|Approved\s+on|---\s*PAGE\s+\d+|Page\s+\d+\s+of\s+\d+)",
    r"^\s*Author and Content Review", r"CONFIDENTIAL", r"^\s*\d{1,3}\s*$", r"^Commented\s*\[",
]

# Words that open a table's column-group caption.
CAPTION_WORDS = ["period", "treatment", "comments", "screening", "washout", "maintenance", "lead-in", "dose escalation", "study"]
PAGE_CAPTION = r"^(?:Table\s+\d+|[A-Z0-9]{2,4}-[A-Z]{2}-[A-Z0-9]{3,6})"

# Labels of a visit header row, its cell tokens, and group titles.
DAY_HEADER_LABELS = ["visit number", "study day", "visit", "day", "assessment day", "cycle day"]
DAY_TOKEN = r"(?i)^-?\d+(\s*to\s*-?\d+)?$|^\(?[±·]\d+\)?$|^(SCR|ET|UV|ED|EOI|EOS)$"
GROUP_TITLE = r"(?i)^(Parts?|Arms?|Waves?|Groups?|Cohorts?)\b"

# Section headings to find by page.
SCHEDULE_START = r"(?i)1\.3\.?\s+Schedule\s+of\s+Activities"
SCHEDULE_END = r"(?im)^\s*(?:1\.4\.|2\.\s)"
APPENDIX_START = r"(?i)10\.2\.?\s+Appendix\s+\d+:?\s*Clinical\s+Lab"
APPENDIX_END = r"(?im)^\s*10\.3\.?\s"
CHANGE_LOG = (
    r"(?i)(?:Revised|Added|Modified|Updated|Clarified)\s+(?:to\s+)?(?:the\s+)?"
    r"(?:requir|language|text|criterion|protocol|section|instruction|panel)"
)

# Words that make a schedule test a panel.
PANEL_WORDS = ["Hematology", "Chemistry", "Lipids", "Urinalysis", "Panel", "Serology", "Hormones", "Antibody", "testing"]
# Fixed value: comment that opens a panel in the appendix (any sponsor).
PANEL_MARKER = r"(?i)assayed\s+by\s+\w+[-\s]?designated\s+laboratory"

# Known sub-sections of question tables.
QUESTION_SECTIONS = [
    "Title", "Overview", "Objectives", "Population", "Peds", "Stats", "Design", "CT Material", "Safety", "Patient Burden",
    "Diversity", "Risk Assessment", "Timeline", "Country Check", "Investigator Insights", "Optionality", "Design Check",
    "Design Alignment", "Objectives / Stats", "Design / CT Material",
]

# Milestones, their other spellings, and dates as written.
MILESTONES = ["Protocol Approval", "FPV", "LPV", "FPET", "LPET", "Protocol Content Lock", "Design Element Alignment"]
MILESTONE_SYNONYMS = {
    "Protocol Approval": ["Protocol Approval Date", "PA Date"],
    "FPV": ["First Patient Visit", "First Patient Enrolled", "First Patient In", "First Patient Dosed", "First Subject In", "FPI", "FSI"],
    "LPV": ["Last Patient Visit", "Last Patient Completed", "Last Patient Out", "Last Subject Out", "LPO", "LSO"],
    "FPET": ["First Patient Entered Treatment", "First Patient Treated"],
    "LPET": ["Last Patient Entered Treatment", "Last Patient Treated"],
}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
WRITTEN_DATE = (
    rf"(?i)\d{{1,2}}[-\s](?:{MONTHS})[-\s]\d{{4}}|(?:{MONTHS})\s+\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}"
)
QUESTION_MILESTONES = [
    ("Protocol Approval", "protocol_approval"), ("First Patient Visit", "fpv"), ("First Patient Entered Treatment", "fpet"),
    ("Last Patient Visit", "lpv"), ("Last Patient Entered Treatment", "lpet"), ("LPV All", "lpv"),
]
QUESTION_BOUNDARIES = [
    "Interim Timepoint(s)", "Interim Timepoint", "Last Patient Visit PO", "Design Alignment", "Design Element Alignment",
    "Protocol Content Lock",
]

# Oncology words, checkpoint-inhibitor words, design keywords.
ONCOLOGY = [
    "oncolog", "cancer", "tumou?r", "malignan", "carcinoma", "metastatic", "neoplasm", "sarcoma", "lymphoma", "leukemia",
    "myeloma", "glioblastoma", "melanoma",
]
CHECKPOINT_INHIBITORS = [
    "immune checkpoint inhibitor", "checkpoint inhibitor", "anti-?PD-?L?1", "anti-?PD-?1", "anti-?CTLA-?4", "pembrolizumab",
    "nivolumab", "atezolizumab", "durvalumab", "ipilimumab", "avelumab", "cemiplimab", "tremelimumab", "dostarlimab",
]
IMMUNO_ONCOLOGY = ["immuno oncology", "immuno-oncology", "io protocol", "checkpoint inhibitor", "anti-pd1", "anti-pdl1"]
DECENTRALIZED = ["decentralized", "mobile nursing", "home health", "virtual trial", "direct to patient"]
TITLE_STOP_WORDS = [
    "Patients", "Subjects", "Participants", "Treatment", "Therapy", "Healthy", "Methodology", "Approach", "Method", "New",
    "Novel", "Injectable", "Oral", "Intravenous", "Subcutaneous", "Topical", "Human", "Clinical", "Single", "Multiple",
    "Following", "Different", "Various", "Several", "Alternative",
]

# Reflex tests: value when a keyword is in the text, value when the test is in the schedule, and keywords.
REFLEX_BY_TEXT = {
    "pregnancy": ("50% of pts", ["additional pregnancy tests", "clinical suspicion of pregnancy"]),
    "ck-mb": (None, ["ck-mb"]),
    "uds": ("Yes - assume 2%", ["urine drug confirmation", "drug screen is positive", "drug confirmation to"]),
    "hbv dna": ("Yes - 1%", ["hbv dna"]),
    "hcv rna": ("Yes - 1%", ["hcv rna"]),
    "hiv": ("Yes - 1%", ["reflex to viral load"]),
    "fsh": ("Yes - 50%", ["postmenopausal", "follicle-stimulating hormone"]),
}
REFLEX_BY_PRESENCE = {
    "pregnancy": ("50% of pts", ["pregnan"]),
    "ck-mb": ("Yes - 1% of CK visits", ["ck-mb", "ck mb"]),
    "uds": ("Yes - assume 2%", ["uds", "urine drug"]),
    "hbv dna": ("Yes - 1%", ["hbv"]),
    "hcv rna": ("Yes - 1%", ["hcv"]),
    "hiv": ("Yes - 1%", ["hiv"]),
    "fsh": ("Yes - 50%", ["fsh", "follicle"]),
}

# Defaults by label, first key wins.
LABEL_DEFAULTS = [
    ("Database Modifications", "5 (default)"), ("Sample metadata", "Monthly (default)"),
    ("Header reconciliation", "Monthly (default)"), ("Data transfer to LabsConnect", "Weekly (default)"),
    ("Kit overage", "50% (default)"), ("Expedited production orders", "10% (default)"),
    ("weekend pick-up", "10% (default)"),
    ("Transportation assumptions", "80% primary cities, 10% secondary cities, 10% tertiary cities (default)"),
]

# JSON keys read first, in order.
PREFERRED_KEYS = ["markdown", "md", "text", "content", "protocol_text", "design_text", "body", "html", "html_content", "pages"]
