"""Fixed values.

These lists, maps and patterns decide results, so they are stated as they are.
Every one is a small constant that does not grow with the data.
"""

# --- fixed values: disciplines -------------------------------------------------

CANONICAL_DISCIPLINES = [
    "Anthropology",
    "Area and Asian Studies",
    "Communication",
    "Demography",
    "Economics",
    "Environmental Studies",
    "Industrial Relations and Labor",
    "Interdisciplinary",
    "Management",
    "Psychology",
    "Public Administration",
    "Sociology",
    "Urban Studies",
    "Women's Studies",
]

# spelling variant -> canonical name
DISCIPLINE_ALIASES = {
    "Area And Asian Studies": "Area and Asian Studies",
    "Area Asian Studies": "Area and Asian Studies",
    "Area Studies": "Area and Asian Studies",
    "Asian Studies": "Area and Asian Studies",
    "Industrial Relations & Labor": "Industrial Relations and Labor",
    "Industrial Relations And Labor": "Industrial Relations and Labor",
    "Industrial Relations Labor": "Industrial Relations and Labor",
    "Women Studies": "Women's Studies",
    "Womens Studies": "Women's Studies",
    "Women'S Studies": "Women's Studies",
}

# canonical name -> category spellings that also count as a match
DISCIPLINE_MATCHES = {
    "Area and Asian Studies": ["Area Studies", "Asian Studies"],
    "Industrial Relations and Labor": ["Industrial Relations & Labor", "Industrial Relations Labor"],
    "Interdisciplinary": ["Social Sciences, Interdisciplinary"],
    "Psychology": [
        "Psychology, Applied",
        "Psychology, Biological",
        "Psychology, Clinical",
        "Psychology, Development",
        "Psychology, Educational",
        "Psychology, Experimental",
        "Psychology, Mathematical",
        "Psychology, Multidisciplinary",
        "Psychology, Psychoanalysis",
        "Psychology, Social",
    ],
    "Women's Studies": ["Women Studies", "Womens Studies", "Women'S Studies"],
}

# canonical name -> list-file prefix to prefer when several exist
PREFERRED_PREFIX = {
    "Area and Asian Studies": "journals_ssci_area_asian_studies_q1",
    "Environmental Studies": "journals_ssci_environmental_studies_q1",
    "Industrial Relations and Labor": "journals_ssci_industrial_relations_labor_q1",
    "Public Administration": "journals_ssci_public_administration_q1",
    "Urban Studies": "journals_ssci_urban_studies_q1",
    "Women's Studies": "journals_ssci_women_studies_q1",
}

# canonical name -> metric-file slugs to try, in order
FALLBACK_SLUGS = {
    "Area and Asian Studies": ["Area_and_Asian_Studies", "Area_Studies", "Asian_Studies"],
    "Industrial Relations and Labor": ["Industrial_Relations_and_Labor", "Industrial_Relations_Labor"],
    "Women's Studies": ["Women_Studies"],
}

# --- fixed values: metric files --------------------------------------------------

EDITION_CODES = ["SCIE", "SSCI", "ESCI", "AHCI"]
KEPT_EDITION = "SSCI"
METRIC_FILE_PATTERN = r"(?i)^WOS_JCR_(\d{6})_(.+)_(\d{6})_normalized\.csv\z"
SOURCE_LIST_PATTERN = r"(?i)^(.*)_(\d{8})_v(\d+)\.ya?ml\z"

# --- fixed values: files and stages ----------------------------------------------

STAGES = ["01_raw", "02_clean", "03_summaries", "04_meta", "05_report", "06_review"]

# stage -> stage whose files it needs
STAGE_INPUT = {
    "02_clean": "01_raw",
    "03_summaries": "02_clean",
    "04_meta": "03_summaries",
    "05_report": "04_meta",
    "06_review": "05_report",
}

LATEST_FILE_LABELS = {
    "papers_latest": "论文列表（最新）",
    "summaries_latest": "结构化摘要（最新）",
    "briefing_latest": "研究简报（最新）",
    "meta_clusters_latest": "聚类结果（最新）",
    "meta_table_latest": "元数据表（最新）",
    "qa_report_latest": "质量报告（最新）",
    "report_latest": "文献简报（最新）",
    "report_compact_latest": "文献简报·紧凑版（最新）",
    "review_latest": "一键综述（最新）",
    "concept_appendix_latest": "概念附录（最新）",
    "concept_briefing_latest": "概念简报（最新）",
    "k_scan_latest": "聚类扫描（最新）",
}

VERSIONED_FILE_LABELS = {
    "papers": "论文列表",
    "papers_clean": "清洗后论文列表",
    "summaries": "结构化摘要",
    "briefing": "研究简报",
    "meta_clusters": "聚类结果",
    "meta_table": "元数据表",
    "qa_report": "质量报告",
    "report": "文献简报",
    "report_compact": "文献简报·紧凑版",
    "review": "一键综述",
    "concept_appendix": "概念附录",
    "concept_briefing": "概念简报",
    "k_scan": "聚类扫描",
}

LATEST_SUFFIX_LABEL = "（最新）"
CURRENT_VERSION_LABEL = "当前使用 (summaries_latest)"

# --- fixed values: text --------------------------------------------------------------

FALLBACK_TOPIC_SLUG = "digital_labor"
FALLBACK_DISCIPLINE_SLUG = "Sociology"
MANUAL_MARK = "[MANUAL]"
NO_TITLE = "（无标题）"
FAILURE_DEFAULT = "综述生成未完成，可能因接口超时或服务异常。建议稍后重试，或查看运行日志了解详情。"

RAW_PLACEHOLDER = r"(?i)^(no usable abstract|n/a|none|unknown|no abstract)\.?$"
SUMMARY_PLACEHOLDER = r"(?i)^(no usable abstract|n/a|none|unknown)\.?$"
SEE_PATTERNS = [r"(?i)^see (the )?(abstract|link|url|paper)", r"(?i)^(abstract )?see:"]
RAW_MIN_CHARS = 25
SUMMARY_MIN_CHARS = 20
SUMMARY_MIN_CORE_CHARS = 30

HEADING_HINTS = [
    "（2-4句话）",
    "（2-5个要点）",
    "（2-4个要点）",
    "（必须覆盖所有论文；用表格；使用文内引用）",
    "（必须覆盖所有论文；按年份降序；用表格）",
    "（必须覆盖所有论文；用表格）",
]
HEADING_HINT_PATTERN = "（基于卡片中的[^）]+2-4个要点）"

SECTION_NUMERALS = "一二三四五六七八九十"

# --- fixed values: limits ------------------------------------------------------------

BATCH_DEFAULT, BATCH_MIN, BATCH_MAX = 12, 1, 999
CHUNK_DEFAULT, CHUNK_MIN, CHUNK_MAX = 22000, 500, 99999
K_DEFAULT, K_MIN, K_MAX = 6, 2, 20
ARCHIVE_DAYS_DEFAULT, ARCHIVE_DAYS_MIN, ARCHIVE_DAYS_MAX = 3, 1, 365
QA_GATE_TOTAL = 100
VERSION_MATCH_MILLIS = 2000

# --- fixed values: patterns ----------------------------------------------------------

# Java's \s is ASCII only; documents also hold NBSP, ideographic space and BOM
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NON_SPACE = r"[^\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

LINK_ANY = r"\[([^\]]*)\]\([^)]*\)"
LINK_FULL = r"\[([^\]]+)\]\(([^)]+)\)"
LINK_NO_TEXT = r"\[\]\(([^)]+)\)"
URL = rf"(?i)https?://{NON_SPACE}+"
DOI = rf"(?i)\b10\.\d{{4,9}}/{NON_SPACE}+"
ID_PAIR = rf"(?i)\b(?:doi|openalex|link|url){SPACE}*[:：]{SPACE}*{NON_SPACE}+"
ID_TOKEN = rf"(?i)\b(?:ISSN|ISBN|PMID){SPACE}*{NON_SPACE}*"

EMPHASIS = r"[*_]{1,3}([^*_]+)[*_]{1,3}"
INLINE_CODE = r"`([^`]+)`"
HEADING_MARK = r"(?m)^#{1,6}\s+"
BULLET_MARK = r"(?m)^\s*[-*+]\s+"
NUMBER_AFTER_PAREN = r"）\s*(\d+)、"
NUMBER_AFTER_BREAK = r"(\*\*|）)\n(\d+)、"
PARENS_ROUND_LINK = r"[（(]\s*(\[[^\]]+\]\(#paper-\d+\))\s*[）)]"

AUTHOR_SEPARATOR = rf"(?i)[,，、;；]|{SPACE}+and{SPACE}+|{SPACE}*&{SPACE}*"
ET_AL = rf"(?i){SPACE}+et{SPACE}+al\.?"
LATIN_AUTHORS = r"^[\x00-\x7F\x{C0}-\x{24F}\x{A0}\x{3000}]+$"

LIST_PREFIX = r"^journals_ssci_"
LIST_SUFFIX = r"(?i)_q1$"
QUARTILE_SUFFIX = r"(?i)\s+Q[1-4]$"
WOMEN_STUDIES = r"(?i)^(.*?)women'?s?\s*studies"
TOPIC = r"^[a-z0-9_/-]+\z"
PLAIN_PATH = r"^[A-Za-z0-9_/. -]+\z"
NON_ENGLISH = r"[^a-zA-Z0-9\s_\-]"
FAILURE_MARK = r"\[FAILURE_REASON\]([^\n]*)"
MANUAL_TAIL = r"(?i)\s*\[MANUAL\]\s*$"
