"""Column functions: text, catalogue fields, citations, file names, predicates."""

from shelfspark.functions.catalogue import *  # noqa: F401,F403
from shelfspark.functions.citations import (  # noqa: F401
    in_text_citation,
    ref_apa,
    ref_chicago,
    ref_sociological,
    ref_url,
    surnames,
)
from shelfspark.functions.files import (  # noqa: F401
    beijing_minute,
    failure_reason,
    line_count,
    qa_counts_parse,
    summaries_version_label,
    version_label,
    version_parse,
)
from shelfspark.functions.predicates import (  # noqa: F401
    abstract_missing_raw,
    abstract_missing_summary,
    drop_manual_mark,
    manual_flag,
    term_non_english,
    topic_valid,
)
from shelfspark.functions.text import (  # noqa: F401
    blank_to_null,
    let,
    md_cell_plain,
    md_display_clean,
    md_paragraph_plain,
    squeeze,
    strip_links_basic,
    strip_links_strict,
    summary_fence,
    trim_all,
)
