"""Default parameters of the jobs.

Fixed values: the numbers, word lists, patterns and text templates below must
stay exactly as written for results to match the documented behaviour of the
log classifier, the document summariser, the e-mail tools and the replay
evaluator.  They are plain data; every job takes them as overridable
parameters.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
# Log classification: hybrid score weights, routing thresholds, prior boost,
# short-prompt limit, truncation length for the fallback classifier queue.
WEIGHT_PHRASE = 0.50
WEIGHT_KEYWORD = 0.30
WEIGHT_DEFINITION = 0.20
HIGH_CONF_THRESHOLD = 0.75
LOW_CONF_THRESHOLD = 0.50
METADATA_BOOST = 1.20
MIN_PROMPT_TOKENS = 5
FALLBACK_PROMPT_TRUNCATE = 300

# Department keyword -> domain code, checked in this order; the first key that
# is a substring of the lower-cased division wins.
DEPARTMENT_DOMAIN_MAP = [
    ("trading", "D02"),
    ("execution", "D02"),
    ("risk", "D03"),
    ("market risk", "D03"),
    ("credit risk", "D03"),
    ("compliance", "D04"),
    ("regulatory", "D04"),
    ("legal", "D04"),
    ("m&a", "D05"),
    ("advisory", "D05"),
    ("dcm", "D05"),
    ("ecm", "D05"),
    ("finance", "D06"),
    ("accounting", "D06"),
    ("technology", "D07"),
    ("engineering", "D07"),
    ("it", "D07"),
    ("research", "D08"),
    ("analytics", "D08"),
    ("hr", "D09"),
    ("people", "D09"),
    ("human resources", "D09"),
]

# Suspicious-keyword watchlist, checked in this order, case-insensitively.
WATCHLIST = [
    "launder", "laundering", "money laundering",
    "insider", "MNPI", "non-public",
    "manipulate", "manipulation", "front run", "front-run",
    "bypass", "circumvent", "avoid detection",
    "off the record", "delete this", "don't tell",
    "shell company", "nominee", "fictitious",
    "bribe", "kickback", "corrupt",
]
WATCHLIST_REASON_PREFIX = "suspicious keyword detected: '"
WATCHLIST_REASON_SUFFIX = "'"

# Label sources, flag levels and output names of the classification job.
LABEL_SEMANTIC, LABEL_LLM, LABEL_UNCLASSIFIED = "semantic", "llm_classify", "unclassified"
FLAG_HIGH, FLAG_MEDIUM, FLAG_NONE = "HIGH", "MEDIUM", "NONE"
SINK_ALL, SINK_HIGH, SINK_MEDIUM, SINK_LLM, SINK_UNCLASSIFIED = (
    "classification_logs", "governance_alerts", "governance_monitoring", "llm_classify_queue", "unclassified")
GOVERNANCE_REASON_SEPARATOR = " | "

# Columns of the classification log, in output order.
OUTPUT_COLUMNS = [
    "session_id", "username", "co", "user_type", "division",
    "combined_prompt", "turn_count",
    "predicted_domain", "domain_confidence",
    "predicted_intent", "intent_confidence",
    "combined_confidence", "label_source",
    "governance_flag", "governance_reason",
    "domain_prior", "first_timestamp", "last_timestamp",
]
REQUIRED_LOG_COLUMNS = [
    "session_id", "query_timestamp", "username",
    "prompt", "co", "user_type", "division",
]

# Document chunking: target size, re-split factor, section-count window
# (sections are used when 1 < boundaries < 30), paragraph separator.
CHUNK_SIZE = 2000
RESPLIT_FACTOR = 1.5
MAX_SECTION_BOUNDARIES = 30
PARAGRAPH_SEP = "\n\n"

# Section-header patterns (Python `re` syntax, no flags).
SECTION_PATTERNS = [
    r"\n\s*(?:SECTION|Section)\s+\d+[.:]\s+\w+",
    r"\n\s*\d+(?:\.\d+)*\s+[A-Z][a-zA-Z\s]+",
    r"\n\s*[IVXLCDM]+\.\s+[A-Z][a-zA-Z\s]+",
    r"\n\s*[A-Z][A-Z\s]{2,}(?:\s*\([^)]+\))?\s*$",
    r"\n\s*(?:ARTICLE|Article)\s+[IVXLCDM]+[.:]\s+\w+",
]

# E-mail header blocks (Python ``re`` syntax; the block pattern is applied
# with DOTALL) and the per-field pattern.
EMAIL_BLOCK_PATTERN = r"From:.*?Subject:.*?(?=\r?\n\r?\n|From:|$)"
EMAIL_FIELD_PATTERN = r"{name}:\s*(.*)"
EMAIL_FIELDS = ["From", "Sent", "To", "Cc", "Subject"]
EMAIL_LIST_SEPARATOR = ";"

# Summariser prompts.  {title}, {chunk}, {author}, {keywords}, {page_count},
# {all_summaries} are filled per document / chunk.
CHUNK_PROMPT_FINANCIAL = """Summarize the following section of a financial document. 
Focus on preserving:
1. Important financial terms, metrics, and numbers
2. Policy statements and legal obligations
3. Risk factors and warnings
4. Key dates, timelines, and deadlines

Document Title: {title}
Document Section:
{chunk}

Provide a concise yet comprehensive summary that maintains all critical financial information and regulatory details:"""

CHUNK_PROMPT_GENERAL = """Summarize the following section of a document.
Document Title: {title}
Document Section:
{chunk}

Provide a concise yet comprehensive summary:"""

FINAL_PROMPT_FINANCIAL = """You are creating a final comprehensive summary of a financial document.
Below are summaries of each section of the document.

Document Title: {title}
Document Author: {author}
Document Keywords: {keywords}
Total Pages: {page_count}

{all_summaries}

Create a well-structured final summary of the entire document that:
1. Preserves all critical financial information, terms, and metrics
2. Maintains all policy statements and compliance requirements
3. Highlights key risk factors and warnings
4. Organizes information logically by sections
5. Includes important dates, deadlines, and timelines

The summary should be comprehensive enough to serve as a reliable reference to the original document:"""

FINAL_PROMPT_GENERAL = """You are creating a final comprehensive summary of a document.
Below are summaries of each section of the document.

Document Title: {title}
Document Author: {author}
Document Keywords: {keywords}
Total Pages: {page_count}

{all_summaries}

Create a well-structured final summary of the entire document that captures all the key information and maintains the logical flow:"""

SECTION_SUMMARY_HEADER = "Section {i} Summary:\n{summary}"
SECTION_SUMMARY_SEP = "\n\n"
CHUNK_ERROR_TEXT = "[Error summarizing this section: {error}]"
UNKNOWN = "Unknown"

# Default completion: prefix + length and digest of the whole prompt.
DIGEST_COMPLETION_PREFIX = "completion of "

# Optional stand-in completion: prefix + first 50 characters of the prompt + "...".
STUB_COMPLETION_PREFIX = "This is where the LLM response would be for: "
STUB_COMPLETION_CHARS = 50
STUB_COMPLETION_SUFFIX = "..."

# E-mail thread review: keys of the per-mail findings object, the list names
# they are gathered under, and the prompt texts.
FINDING_LIST_KEYS = [
    ("new_commitments", "commitments"),
    ("monetary_mentions", "monetary_mentions"),
    ("deadlines", "deadlines"),
    ("legal_triggers", "legal_triggers"),
    ("escalation_flags", "escalation_flags"),
]
FINDING_SUMMARY_KEY = "summary_update"

FINDINGS_SYSTEM_MESSAGE = """You are a senior legal investigation officer analyzing corporate email chains related to a finance legal matter.

Your responsibilities:
- Extract key financial commitments
- Identify monetary amounts
- Detect deadlines and missed obligations
- Detect dispute/escalation language
- Extract legal trigger terms (breach, default, liability, indemnity, notice, termination)
- Track evolving tone
- Maintain structured state across emails

Always respond in structured JSON format with the following keys:
{
  "new_commitments": [],
  "monetary_mentions": [],
  "deadlines": [],
  "legal_triggers": [],
  "escalation_flags": [],
  "summary_update": ""
}

Be precise and forensic. No narrative explanations outside JSON.
"""

FINDINGS_USER_MESSAGE = """
Previous Investigation Summary:
{summary}

Current Email:
{email}

Update the structured investigation findings.
"""

FINDINGS_REPORT_MESSAGE = """
Complete Email Chain Investigation Summary:
{summary}

Aggregated Findings:
{findings}

Provide final investigation conclusion in structured JSON:
{{
  "overall_risk_level": "",
  "primary_issue": "",
  "missed_commitments": [],
  "financial_exposure_summary": "",
  "recommended_next_legal_action": ""
}}
"""

SUMMARY_SYSTEM_MESSAGE = """You are a senior legal investigation officer reviewing a finance-related email chain.

Your task:
- Maintain a running summary of the entire conversation.
- Each time, refine and enrich the previous summary using the new email.
- Preserve key financial discussions, commitments, disputes, legal terms, deadlines, and tone shifts.
- Keep the summary concise but comprehensive.
- Do NOT repeat raw email content.
- Produce a single coherent updated summary each time.
"""

SUMMARY_USER_MESSAGE = """
Previous Summary:
{summary}

New Email:
{email}

Update and enrich the overall conversation summary considering the new email.
Return only the updated full summary.
"""
SUMMARY_INITIAL_STATE = "No prior summary."

# Chat-prompt framing used by the thread jobs.
CHAT_FRAME = "<|system|>{system}<|end|><|user|>{user}<|end|><|assistant|>"

# Replay evaluation: roles, column-name candidates per role (priority order)
# and the roles each metric needs.
ROLE_INPUT = "RECORD_ROOT.INPUT"
ROLE_QUERY = "RETRIEVAL.QUERY_TEXT"
ROLE_OUTPUT = "RECORD_ROOT.OUTPUT"
ROLE_TRUTH = "RECORD_ROOT.GROUND_TRUTH_OUTPUT"
ROLE_CONTEXTS = "RETRIEVAL.RETRIEVED_CONTEXTS"
INPUT_NAMES = ["input", "prompt", "query", "user_query", "question", "prompt_text"]
OUTPUT_NAMES = ["output", "response", "answer", "generated", "model_output"]
GROUND_TRUTH_NAMES = ["ground_truth", "golden_answer", "golden", "expected", "target"]
CONTEXT_NAMES = ["context", "retrieved_contexts", "contexts", "kb", "passages"]
METRIC_ROLES = [
    ("correctness", ["RECORD_ROOT.INPUT", "RECORD_ROOT.OUTPUT", "RECORD_ROOT.GROUND_TRUTH_OUTPUT"]),
    ("answer_relevance", ["RECORD_ROOT.INPUT", "RECORD_ROOT.OUTPUT"]),
    ("context_relevance", ["RETRIEVAL.QUERY_TEXT", "RETRIEVAL.RETRIEVED_CONTEXTS"]),
    ("groundedness", ["RETRIEVAL.RETRIEVED_CONTEXTS", "RECORD_ROOT.OUTPUT"]),
    ("coherence", ["RECORD_ROOT.OUTPUT"]),
]
# ------------------------------------------------------------ end fixed values

# The English stop words of Spark ML's StopWordsRemover.
ENGLISH_STOP_WORDS: tuple[str, ...] = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split())

# Layouts of log timestamps that are tried in this order where the ISO forms do not fit.
TIMESTAMP_FORMATS: tuple[str, ...] = (
    "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yyyy",
    "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d.M.yyyy H:mm:ss", "d.M.yyyy H:mm", "d.M.yyyy",
    "d MMM yyyy H:mm:ss", "d MMM yyyy H:mm", "MMM d, yyyy H:mm",
)
