"""Word lists, formats and thresholds the results depend on.

Everything in this module is data that has to equal the published rule set for
the findings to be the same.  No logic lives here.  Regex text is written in
the subset shared by Java, RE2 and Python, so braces meant literally are
escaped and no inline flags or verbose mode are used.
"""

# --- word groups shared by several patterns -------------------------------
SYSTEM_WORDS = r"(system_prompt|system_msg|sys_prompt|instructions|base_prompt|SYSTEM_PROMPT)"
USER_WORDS = r"(user_input|user_msg|user_message|query|prompt|input_text|message|question)"
MODEL_CALLS = (
    r"(\.call\(|\.invoke\(|\.generate\(|\.chat\(|\.complete\(|\.create\(|openai\.|anthropic\.|\.messages\.create)"
)
SENSITIVE_WORDS = (
    r"(password|passwd|secret|token|api_key|apikey|credential|private_key|cert|auth_token|access_key)"
)
MODEL_IO_WORDS = r"(response|output|answer|completion|messages|conversation|chat_history|llm_result)"

# --- one character that does not open a new def / class / decorator line ---
SAME_BLOCK = r"(?:(?!\n\s*(?:def\s|class\s|@)).)"

# --- hosts for SC-001 #3 and URL families for SC-002 -----------------------
DROP_HOSTS = (
    r"paste|raw|gist|hastebin|termbin|ix\.io|rentry|justpaste|0x0\.st|transfer\.sh|file\.io|anonfiles"
    r"|webhook\.site|pipedream|requestbin|hookbin|beeceptor|mockbin|postb\.in|en\.wtools"
)
DROP_URLS = (
    r"https?://(?:"
    r"paste(?:bin)?\.(?:com|ee|org|net|pl|de|fr|es|it|nl|ru)"
    r"|(?:raw|gist)\.github(?:usercontent)?\.com/[^/\s\"']+/[^/\s\"']+/raw/"
    r"|rentry\.co/[^\s\"']+/raw"
    r"|justpaste\.it/[^\s\"']+"
    r"|hastebin\.(?:com|skyra\.pw)"
    r"|termbin\.com/[^\s\"']+"
    r"|ix\.io/[^\s\"']+"
    r"|0x0\.st/[^\s\"']+"
    r"|transfer\.sh/[^\s\"']+"
    r"|file\.io/[^\s\"']+"
    r"|anonfiles\.com/[^\s\"']+"
    r"|webhook\.site/[^\s\"']+"
    r"|pipedream\.(?:net|com)/[^\s\"']+"
    r"|requestbin\.(?:com|net|org)/[^\s\"']+"
    r"|hookbin\.com/[^\s\"']+"
    r"|beeceptor\.com/[^\s\"']+"
    r"|mockbin\.(?:org|com)/[^\s\"']+"
    r"|postb\.in/[^\s\"']+"
    r"|en\.wtools\.io/[^\s\"']+"
    r")"
)

# --- tool descriptions (MCP-004) ------------------------------------------
DESCRIPTION_PLACES = (
    r"(?:description\s*=\s*[\"'][^\"']{10,200}[\"'])"
    r"|(?:description\s*:\s*[\"'][^\"']{10,200}[\"'])"
    r"|(?:def\s+\w+.*\n\s*[\"']{3}[^\"']{10,500}[\"']{3})"
)
INJECTION_PHRASES = (
    r"\b(?:IMPORTANT|CRITICAL|MANDATORY|ESSENTIAL)\s*:\s*You\s+MUST"
    r"|\b(?:ignore|forget|disregard)\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|rules?|prompts?|context)"
    r"|\b(?:output|print|reveal|display|show|repeat)\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions?|rules?|directives?)"
    r"|\b(?:you\s+are\s+now|from\s+now\s+on\s+you\s+are|your\s+new\s+role\s+is|act\s+as\s+a\s+different)"
    r"|\b(?:send|upload|forward|transmit)\s+(?:the\s+)?(?:user'?s?\s+)?(?:data|input|message|conversation|prompt|api[_\s]?key|token|password)\s+to\s+"
    r"|\b(?:this\s+tool\s+(?:must|should\s+always)\s+be\s+(?:called|used|invoked|run)\s+(?:first|before|prior))"
    r"|\b(?:base64|rot13|hex\s+encode)\s+(?:your\s+)?(?:response|output|answer)"
)
PHRASE_SHOWN_CHARS = 120
DESCRIPTION_SHOWN_CHARS = 500

# --- tool-server configuration (MCP-001..003) ------------------------------
CONFIG_NAMES = ("mcp.json", "mcp_servers.json", "claude_desktop_config.json", ".cursor/mcp.json")
AUTH_HEADERS = (
    "authorization", "auth", "api_key", "apikey", "token", "oauth", "credentials", "access_token", "x-api-key",
)
AUTH_ENV_WORDS = ("token", "key", "secret", "auth", "password", "oauth")
AUTH_FLAGS = ("--token", "--key", "--auth", "--api-key", "--bearer")
SECRET_VALUE = (
    r"(?:sk-[A-Za-z0-9_-]{10,}|AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}"
    r"|xox[bpsar]-\d+-\d+-[A-Za-z0-9]{20,}|[A-Za-z0-9+/=]{32,})"
)
WRITABLE_PATHS = (
    "node_modules/.bin", ".venv", "venv", "env/bin", "./", "../", "~/", "%USERPROFILE%", "${HOME}",
)
SHELL_COMMANDS = ("sh", "bash", "cmd", "cmd.exe", "powershell", "pwsh")
SERVER_SNIPPET_CHARS = 600
SNIPPET_CUT_MARK = "\n... [truncated]"
REDACTED = "***REDACTED***"

# --- which files are read ---------------------------------------------------
DEFAULT_GLOBS = ("*.py", "*.js", "*.ts", "*.tsx", "*.jsx", "*.json", ".cursorrules", ".windsurfrules")
SKIPPED_DIRS = (
    "node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next", "egg-info", ".tox",
    "targets", ".tmp", "plugins", "archive", "reports",
)
MINIFIED_FEW_LINES = 3
MINIFIED_MIN_CHARS = 500
MINIFIED_MEAN_LINE = 400
CONTEXT_LINES = 3
MIN_RULES = 4

# --- severities, grades, gates ----------------------------------------------
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
DISPLAY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
SEVERE = ("critical", "high")
GRADE_WEIGHTS = {"critical": 10, "high": 4, "medium": 1}
GRADE_LIMITS = ((0, "A+"), (2, "A"), (5, "B"), (10, "C"), (20, "D"))
WORST_GRADE = "F"
CLEAN_GRADES = ("A+", "A")

# --- triage ------------------------------------------------------------------
BATCH_SIZE = 12
FILE_CHAR_LIMIT = 32_000
FILE_CUT_MARK = "\n... [truncated] ...\n"
CHAIN_CHAR_LIMIT = 48_000
NOT_ANALYSED = "Not yet analyzed"
CHAIN_DEFAULT_NAME = "Unnamed Campaign"
CHAIN_DEFAULT_RISK = "HIGH"
AUDIT_FIX_HEAD = "[L3 DeepSeek Analysis]\n"
OLD_FIX_HEAD = "\n\n[L1 Suggestion]\n"

# --- documented quality gates --------------------------------------------------
GATE_RECALL, GATE_PRECISION, GATE_F1, GATE_CRITICAL_RECALL = 0.90, 0.70, 0.78, 1.00
GATE_COUNT_SPREAD, GATE_JACCARD, GATE_VERDICT_AGREEMENT, GATE_NOISE_CUT = 0.10, 0.85, 0.90, 0.30
