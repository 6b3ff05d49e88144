"""Word lists, code tables, weights and patterns that results depend on, stated as they are."""

from __future__ import annotations

# Fixed values of the normaliser.
NULL_TOKENS = ["", "n/a", "na", "null", "none", "-", "--", "nil", "unknown", "undefined", "#n/a", "nan"]
ZERO_WIDTH = ["​", "‌", "‍", "﻿", "­"]
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "œ": "oe", "æ": "ae"}
PROVINCES = {
    "gp": "Gauteng", "gau": "Gauteng", "gauteng": "Gauteng", "kzn": "KwaZulu-Natal", "kwazulu-natal": "KwaZulu-Natal",
    "wc": "Western Cape", "western cape": "Western Cape", "ec": "Eastern Cape", "eastern cape": "Eastern Cape",
    "fs": "Free State", "free state": "Free State", "mp": "Mpumalanga", "mpu": "Mpumalanga", "mpumalanga": "Mpumalanga",
    "lp": "Limpopo", "lim": "Limpopo", "limpopo": "Limpopo", "nw": "North West", "north west": "North West",
    "nc": "Northern Cape", "northern cape": "Northern Cape", "national": "National",
}

#: Parts of the names of fields that hold codes.
CODE_FIELD_PARTS = ["id", "code", "ofo", "saqa"]

# Fixed values of the taxonomy: code, title, and affinity or chambers.
MAJOR_GROUPS = [
    ("1", "Managers", "0.35"), ("2", "Professionals", "0.80"), ("3", "Technicians and Associate Professionals", "0.90"),
    ("4", "Clerical Support Workers", "0.20"), ("5", "Service and Sales Workers", "0.25"),
    ("6", "Skilled Agricultural, Forestry, Fishery, Craft and Related Trades Workers", "0.95"),
    ("7", "Plant and Machine Operators and Assemblers", "0.95"), ("8", "Elementary Occupations", "0.30"),
]
METAL, AUTO, PLASTIC, TYRE = "Metal & Engineering", "Automotive Manufacturing", "Plastics Manufacturing", "Tyre Manufacturing"
RETAIL, COMPONENTS, CROSS = "Motor Retail", "Components Manufacturing", "Cross-Chamber Technical Trades"
SUB_MAJOR_GROUPS = [
    ("21", "Science and Engineering Professionals", "0.95", [METAL, AUTO]), ("22", "Health Professionals", "0.05", []),
    ("23", "Teaching Professionals", "0.10", []), ("24", "Business and Administration Professionals", "0.25", []),
    ("25", "Information and Communications Technology Professionals", "0.70", [CROSS]),
    ("31", "Science and Engineering Associate Professionals / Technicians", "0.95", [METAL, AUTO, PLASTIC]),
    ("32", "Health Associate Professionals", "0.05", []), ("33", "Business and Administration Associate Professionals", "0.25", []),
    ("64", "Building and Related Trades Workers", "0.75", [METAL]),
    ("65", "Metal, Machinery and Related Trades Workers", "0.98", [METAL, AUTO, TYRE]),
    ("67", "Precision, Handicraft, Craft Printing and Related Trades Workers", "0.85", [PLASTIC, METAL]),
    ("68", "Electrical and Electronic Trades Workers", "0.95", [METAL, AUTO]),
    ("71", "Stationary Plant and Machine Operators", "0.95", [PLASTIC, TYRE, METAL]), ("72", "Assemblers", "0.98", [AUTO, COMPONENTS, TYRE]),
    ("73", "Drivers and Mobile Plant Operators", "0.50", [AUTO]),
]
MINOR_GROUPS = [
    ("214", "Engineering Professionals (excluding Electrotechnology)"), ("215", "Electrotechnology Engineers"),
    ("216", "Architects, Planners, Surveyors and Designers"), ("311", "Physical and Engineering Science Technicians"),
    ("312", "Mining, Manufacturing and Construction Supervisors"), ("313", "Process Control Technicians"),
    ("315", "Ship and Aircraft Controllers and Technicians"), ("651", "Blacksmiths, Toolmakers and Related Trades Workers"),
    ("652", "Machinery Mechanics and Fitters"), ("653", "Electrical Equipment Fitters and Repairers"),
    ("671", "Metal Polishers, Wheel Grinders and Tool Sharpeners"), ("711", "Mining and Mineral Processing Plant Operators"),
    ("712", "Metal Processing and Finishing Plant Operators"), ("713", "Chemical and Plastics Processing Plant Operators"),
    ("714", "Rubber and Plastic Products Machine Operators"), ("721", "Mechanical, Electrical and Electronic Assemblers"),
]
UNIT_GROUPS = [
    ("2144", "Mechanical Engineers", [METAL, AUTO]), ("2145", "Chemical Engineers", [PLASTIC, METAL]),
    ("2146", "Mining Engineers, Metallurgists and Related Professionals", [METAL]),
    ("2149", "Engineering Professionals Not Elsewhere Classified", [METAL]), ("3115", "Mechanical Engineering Technicians", [METAL, AUTO]),
    ("3119", "Physical and Engineering Science Technicians Not Elsewhere Classified", [METAL]),
    ("3122", "Manufacturing Supervisors", [METAL, AUTO, PLASTIC]), ("6512", "Toolmakers and Related Workers", [METAL, AUTO]),
    ("6522", "Motor Vehicle Mechanics and Repairers", [AUTO, RETAIL]),
    ("6523", "Agricultural and Industrial Machinery Mechanics and Fitters", [METAL]), ("6531", "Electrical Fitters", [METAL, CROSS]),
    ("7141", "Rubber Products Machine Operators", [TYRE]), ("7142", "Plastic Products Machine Operators", [PLASTIC]),
    ("7211", "Mechanical Machinery Assemblers", [METAL, AUTO]), ("7214", "Electrical and Electronic Equipment Assemblers", [COMPONENTS]),
]

# Fixed values of the relevance rules.
TECHNICAL_CORE = [
    "engineering", "mechanic", "mechanical", "electrical", "electronic", "metal", "machinist", "toolmaker", "fitter", "welder", "boiler",
    "turner", "automotive", "diesel", "panelbeater", "spraypainter", "plastics", "polymer", "injection", "moulding", "tyre", "rubber",
    "vulcanis", "assembler", "fabricat", "artisan", "instrumentation", "mechatronic", "robotics", "automation", "cad", "draughting",
    "metallurg", "foundry", "casting",
]
SUPPORT_ROLES = [
    "accountant", "bookkeeper", "auditor", "financial controller", "payroll clerk", "cleaner", "sweeper", "office cleaner", "janitor",
    "tea lady", "cook", "kitchen hand", "receptionist", "secretary", "switchboard", "filing clerk", "lawyer", "attorney", "paralegal",
    "legal advisor", "nurse", "clinic sister", "doctor", "travel agent", "hotel receptionist", "waiter", "bartender",
]
EXCLUDED_ROLES = [
    "teacher", "primary school teacher", "kindergarten", "beautician", "hairdresser", "librarian", "hotel receptionist", "waiter",
    "bartender", "flight attendant", "travel agent", "actuary", "lawyer", "judge", "paralegal", "dentist", "surgeon", "pharmacist",
    "physician", "nurse", "midwife",
]
LEADERSHIP_ROLES = ["operations manager", "general manager", "production manager", "shift supervisor", "factory manager", "plant coordinator"]
LEADERSHIP_QUALIFIERS = ["die", "mould", "tool", "mechanical", "electrical", "welding"]
INDUSTRIAL_QUALIFIERS = ["industrial", "automotive", "engineering"]
PROCESS_WORDS = ["machin", "technic", "artisan", "fitter", "welder", "operator", "assembler"]
NON_TECHNICAL_TITLES = [
    "accountant", "bookkeeper", "auditor", "financial officer", "payroll clerk", "cleaner", "sweeper", "office cleaner", "janitor",
    "tea lady", "cook", "receptionist", "secretary", "filing clerk", "switchboard operator", "lawyer", "attorney", "paralegal",
    "legal advisor", "nurse", "clinic sister", "paramedic", "security guard", "caretaker",
]
TECHNICAL_TITLES = ["engineer", "technician", "artisan", "fitter", "welder", "machinist", "toolmaker"]
INDUSTRIAL_EMPLOYERS = ["motor", "automotive", "tyre", "rubber", "plastics", "metal", "engineering", "foundry"]
TITLE_CHAMBERS = [
    (["motor", "vehicle", "auto"], AUTO), (["metal", "weld", "fitter", "tool"], METAL), (["plastic", "polymer", "mould"], PLASTIC), (["tyre", "rubber"], TYRE),
]
TIERS = ["technician", "technologist", "engineer", "artisan", "mechanic", "operator", "supervisor"]

# Fixed values of the policies: include and exclude thresholds, then (rule, weight).
POLICIES = {
    "occupational_relevance": ("0.85", "0.55", [
        ("direct_sector_match", "0.30"), ("occupational_classification", "0.25"), ("manufacturing_context", "0.20"),
        ("technical_process_relevance", "0.15"), ("source_document_evidence", "0.10"),
    ]),
    "college_priority": ("0.80", "0.50", [("saqa_registration", "0.35"), ("artisan_pathway", "0.35"), ("college_delivery", "0.30")]),
    "green_skills": ("0.80", "0.50", [("clean_tech_match", "0.40"), ("resource_efficiency", "0.35"), ("environmental_compliance", "0.25")]),
    "universal": ("0.80", "0.50", [("scope_match", "0.40"), ("inclusion_criteria", "0.40"), ("exclusion_guard", "0.20")]),
}
#: The family by which each rule is judged; inclusion_criteria has none.
RULE_FAMILIES = {
    "sector": ["direct_sector_match", "clean_tech_match", "scope_match"], "classification": ["occupational_classification", "artisan_pathway"],
    "context": ["manufacturing_context", "resource_efficiency", "college_delivery"],
    "process": ["technical_process_relevance", "environmental_compliance"],
    "source": ["source_document_evidence", "saqa_registration", "exclusion_guard"],
}

# Fixed values of the quality score.
QUALITY_WEIGHTS = {
    "extraction": "0.15", "structural": "0.10", "normalization": "0.10", "validation": "0.20", "completeness": "0.15", "consistency": "0.10",
    "curation": "0.10", "provenance": "0.10",
}

# Fixed values of document discovery.
FINAL_WORDS = ["final list", "final oihd", "occupations in high demand", "selected occupations", "authoritative list", "final dataset", "oihd in mpumalanga", "priority skills list", "master list"]
SURVEY_WORDS = ["survey response mapping", "survey responses", "survey questions", "employer survey", "respondents", "survey sample", "questionnaire"]
INTERMEDIATE_WORDS = [
    "top 10", "variables used", "historical overview", "indicators used", "regression results", "sample description", "scoring range", "demand score ranges",
]
UNIT_SIGNALS = {
    "occupation": ("1.5", [
        "ofo", "occupation", "job title", "trade", "artisan", "technician", "technologist", "engineer", "mechanic", "operator", "manager", "clerk",
        "specialist", "practitioner", "analyst", "moulder", "welder", "fitter",
    ]),
    "qualification": ("1.5", ["saqa", "nqf", "qualification", "diploma", "degree", "certificate", "learnership", "curriculum", "subframe", "accreditation", "programme"]),
    "survey_response": ("1.5", ["survey", "respondent", "response", "question", "enterprise size", "micro", "small", "medium", "large", "mentions", "frequency", "score"]),
    "variable": ("2.0", ["variable", "var_name", "label", "codebook", "storage type", "value labels", "data type", "missing value", "format"]),
    "industry": ("1.5", ["sic", "industry", "sector", "gdp", "employment growth", "economic sector", "manufacturing", "mining", "agriculture"]),
    "province": ("1.5", [
        "province", "provincial", "gauteng", "mpumalanga", "kwazulu-natal", "western cape", "eastern cape", "limpopo", "free state", "north west", "northern cape",
    ]),
    "company": ("2.5", ["company", "enterprise", "employer", "firm", "organisation", "organization", "sdl number"]),
}
QUALIFICATION_WORDS = [
    "Honours Degree", "Postgraduate Diploma", "Bachelor's Degree", "Master's Degree", "Doctoral Degree", "Diploma", "National Certificate", "Advanced Certificate",
    "Advanced Diploma", "Higher Certificate", "Intermediate Certificate", "Professional Driving Permit", "No Formal Qualification Required",
    "General Education and Training Certificate",
]
#: A page footer that runs into the last cell.
CELL_FOOTER = r"(?i)\s+[0-9]+\s+MPUMALANGA.*$"
METADATA_WORDS = ["acronyms", "abbreviations", "table of contents", "list of tables", "list of figures", "document history", "version control"]
#: Section kinds that give a table its role, in order after the words of the table itself.
SECTION_ROLES = [("METHODOLOGY", "methodology"), ("EVIDENCE", "evidence")]

# ---- Fixed values: headings, metadata, column roles and header aliases ---------------------------

#: Heading groups in order; the first with a matching word counts.
HEADING_GROUPS = [
    ("FRONT_MATTER", ["acknowledgements", "table of contents", "contents", "list of figures", "list of tables", "acronyms", "abbreviations"]),
    ("INTRODUCTION", ["introduction", "background", "executive summary", "context", "overview", "purpose", "scope"]),
    ("METHODOLOGY", ["methodology", "research method", "methods", "approach", "study design", "data collection", "evolution of the methodology", "evolution", "analytical framework"]),
    ("EVIDENCE", ["secondary data analysis", "primary data analysis", "survey data", "labour market", "labour market and economy", "evidence", "indicators", "demand score"]),
    ("FINAL_LIST", ["consolidation of evidence and the final list", "consolidation", "the final list", "final list", "occupations in high demand", "selected occupations", "target dataset", "final oihd"]),
    ("RESULTS", ["results", "findings", "key findings", "analysis"]),
    ("CONCLUSION", ["conclusion", "recommendations", "policy implications", "summary"]),
    ("APPENDIX", ["annexure", "annexures", "appendix", "appendices", "survey questions", "survey response mapping"]),
    ("REFERENCES", ["references", "bibliography", "works cited"]),
]
#: Part, annexure, front matter, numbered and major headings.
HEADING_PATTERNS = [
    r"^(?i)(PART\s+[0-9IVXLCDM]+)\b",
    r"^(?i)(ANNEXURE\s+[0-9A-Z]+|APPENDIX\s+[0-9A-Z]+)\b",
    r"^(?i)(Table of Contents|Acknowledgements|List of Figures|List of Tables|Acronyms and Abbreviations)$",
    r"^([0-9]+\.[0-9]+(\.[0-9]+)?)\s+([A-Z][A-Za-z0-9\s,\-\(\)'’]+)$",
    r"^([0-9]+)\s+([A-Z\s]{4,})$",
]
RUNNING_HEADERS = [r"^[0-9]+\s+[A-Z\s’']+$", r"^[A-Z\s’']+\s+[0-9]+$"]
TITLE_PATTERNS = [
    r"(?i)([A-Z0-9\s’']+:\s+A TECHNICAL RESEARCH REPORT)",
    r"(?i)(Mpumalanga[’']?s List of Occupations in High Demand[^\n\r]+)",
    r"(?i)([A-Z][A-Za-z0-9\s’']{10,80}\s+Report)",
]
PUBLISHERS = [
    ("Department of Higher Education and Training", "Department of Higher Education and Training (DHET)"),
    ("DNA Economics", "DNA Economics"),
]
AUTHOR_BLOCK = r"(?i)Authors\s*\n+([^\n]+(?:\n+[^\n]+){1,3})"
#: Column roles in order, by parts of the name.
COLUMN_ROLES = [
    ("identifiers", ["code", "id", "number", "reg_no", "identifier"]),
    ("titles", ["title", "name", "occupation", "qualification", "programme", "label"]),
    ("classifications", ["level", "nqf", "subframe", "category", "type", "chamber", "sector", "industry"]),
    ("requirements", ["min_", "require", "prereq", "entry_"]),
    ("geographic", ["province", "region", "district", "municipality", "city"]),
    ("metrics", ["count", "score", "weight", "share", "rate", "percent", "amount", "total"]),
]
FORCED_STRINGS = ["saqa", "ofo", "code", "id"]
REQUIRED_PARTS = ["id", "code", "title", "name"]
#: Units of a dataset: parts of column names, parts of the schema name, and the unit.
DATASET_UNITS = [
    (["ofo", "occup"], ["occup", "oihd"], "Occupation"),
    (["saqa", "qual", "programme"], ["qual"], "Qualification"),
    (["var_name", "variable"], ["codebook"], "Variable"),
    (["company", "employer", "enterprise"], [], "Company / Enterprise"),
    (["province", "region", "district"], None, "Geographic Region"),
    (["indicator", "metric"], [], "Economic / Labour Indicator"),
]
#: Header aliases of the two list readers, in field order.
QUALIFICATION_ALIASES = [
    ("saqa_id", ["saqa", "qual id", "qualification id", "code", "qual code", "id"]),
    ("qualification", ["qualification", "learning programme", "programme", "title", "description", "qual title", "occupational qualification"]),
    ("nqf_level", ["nqf", "level", "nqf level"]),
    ("framework", ["sub-framework", "framework", "subframework", "qualification type", "type"]),
    ("nsfas_eligible", ["nsfas", "funded", "bursary", "eligible", "nsfas eligible"]),
    ("participating_colleges", ["college", "colleges", "delivery centre", "offering", "institution", "campus", "tvet", "provider"]),
]
OCCUPATION_ALIASES = [
    ("ofo_code", ["ofo", "code", "ofo code", "occupation code", "unit group", "unit"]),
    ("occupation_title", ["occupation", "title", "occupation title", "description", "job title", "name"]),
    ("demand_rank", ["rank", "ranking", "demand", "priority", "demand rank", "priority level"]),
    ("major_group", ["major group", "group", "sub-major", "ofo group", "occupational group"]),
    ("province", ["province", "region", "provincial", "location", "prov"]),
    ("educational_qualification_req", ["qualification", "entry requirement", "education", "minimum qualification", "requirement"]),
]
#: Words in the first cell of a row that show a repeated header.
QUALIFICATION_HEADER_WORDS = ["saqa", "qual id", "national qual"]
OCCUPATION_HEADER_WORDS = ["ofo", "code", "occupation"]
#: Parts of a header whose cells list institutions.
INSTITUTION_PARTS = ["college", "institution", "centre", "campus", "provider"]
#: Header families: parts of a header, parts it must not have, parts of the target column, parts that must not have.
HEADER_FAMILIES = [
    (["saqa"], [], ["saqa"], []),
    (["sub_frame", "subframe", "nqf sub"], [], ["sub", "frame"], []),
    (["qual", "title", "programme"], ["sub"], ["qual", "title", "prog"], []),
    (["number", "code", "curriculum"], ["saqa"], ["number", "code"], ["saqa"]),
    (["nsfas", "allowan", "bursary", "fund"], [], ["nsfas", "allow"], []),
    (["college", "campus", "institution", "provider"], [], ["college", "campus", "inst"], []),
]
OFFLINE_TITLES = ["engineer", "technician", "mechanic", "fitter", "artisan", "machinist"]

# Fixed values of stated record counts: patterns with the count as their group, in any case.
STATED_PATTERNS = [
    r"\b(?:total|list of|identified|reveals|mapped[^0-9]{1,10})\s+([0-9]{1,4})\s+(?:occupations|oihd|qualifications|items|trades|skills)\b",
    r"\b([0-9]{1,4})\s+(?:oihd|occupations in high demand)\b",
    r"total\s+occupations\s+([0-9]{1,4})",
]
#: A count up to this is no statement, and what is shown around one.
STATED_ABOVE, STATED_CONTEXT = 5, 40
#: A caption part of tables that go on over any number of captions.
CONTINUED_CAPTION = "table 4"

# Fixed values of knowledge reports: the headings of their sections.
REPORT_SECTIONS = [
    "DATASET IDENTITY", "SOURCE DOCUMENT", "DATASET DESCRIPTION", "UNIT OF OBSERVATION", "DATASET STATISTICS", "SCHEMA KNOWLEDGE", "DOMAIN ENTITIES", "DOMAIN VOCABULARY & NORMALIZATION AUDIT",
    "DIRECT FACTUAL RELATIONSHIPS", "DERIVED RESEARCH DATA POINTS", "RECORD-LEVEL KNOWLEDGE (CURATED & AUDITED)", "CURATION GOVERNANCE STATUS", "VALIDATION STATUS", "RESEARCH QUALITY GATES",
    "PROVENANCE & LINEAGE TRACEABILITY", "RESEARCH NOTES & METHODOLOGICAL CONTEXT",
]

# Fixed values of the built-in blueprints: name, category and primary key, then fields with their aliases, type, whether required, pattern, least and most, and allowed values.
BLUEPRINTS = {
    "qualifications": ("TVET & Higher Education Qualifications", "education", "saqa_id", [
        ("saqa_id", ["saqa", "saqa id", "qual id", "qualification id", "code", "id"], "string", True, "[0-9]{4,7}", None, None, None),
        ("qualification_name", ["qualification", "learning programme", "programme", "title", "description"], "string", True, None, None, None, None),
        ("nqf_level", ["nqf", "level", "nqf level"], "integer", False, None, 1.0, 10.0, None),
        ("nqf_sub_framework", ["sub-framework", "framework", "subframework", "qualification type"], "string", False, None, None, None, ["OQSF", "HEQSF", "GFETQSF"]),
        ("nsfas_eligible", ["nsfas", "funded", "bursary", "eligible"], "boolean", False, None, None, None, None),
        ("participating_colleges", ["college", "colleges", "delivery centre", "offering", "institution", "campus", "tvet", "provider"], "string", False, None, None, None, None),
    ]),
    "occupations": ("Occupations in High Demand (OIHD / OFO)", "labour_market", "ofo_code", [
        ("ofo_code", ["ofo", "ofo code", "occupation code", "code"], "string", True, "[0-9]{4,6}", None, None, None),
        ("occupation_title", ["occupation", "title", "description", "occupation title"], "string", True, None, None, None, None),
        ("priority_rank", ["rank", "priority", "demand rank"], "integer", False, None, 1.0, None, None),
        ("major_group", ["group", "major group", "category"], "string", False, None, None, None, None),
        ("province", ["province", "region", "location"], "string", False, None, None, None, None),
        ("entry_qualification", ["qualification", "entry level", "requirement", "minimum qual"], "string", False, None, None, None, None),
    ]),
    "codebooks": ("Survey Metadata & Variable Codebooks", "statistics", "variable_name", [
        ("variable_name", ["variable", "var_name", "variable name", "field"], "string", True, None, None, None, None),
        ("variable_label", ["label", "var_label", "variable label", "description"], "string", False, None, None, None, None),
        ("value_code", ["value", "code", "val", "category_code"], "string", False, None, None, None, None),
        ("value_label", ["value label", "cat_label", "category_label", "meaning"], "string", False, None, None, None, None),
    ]),
    "financial": ("Financial Statements & Balance Sheets", "finance", "account_code", [
        ("account_code", ["account", "code", "item_no", "ref"], "string", False, None, None, None, None),
        ("line_item", ["description", "line item", "account name", "particulars"], "string", True, None, None, None, None),
        ("amount", ["amount", "value", "balance", "total", "sum"], "currency", True, None, None, None, None),
        ("period", ["year", "period", "date", "fy"], "string", False, None, None, None, None),
    ]),
    "universal_auto": ("Universal AI Auto-Inferred Schema", "general", None, []),
}
