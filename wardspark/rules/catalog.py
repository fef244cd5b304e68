"""The built-in rules: 19 shipped ones and 3 that are documented only.

Regexes, severities, OWASP ids, file globs and rule order are fixed values;
titles, descriptions and fixes are our own wording.
"""

from __future__ import annotations

from .fixed import (
    DESCRIPTION_PLACES, DROP_HOSTS, DROP_URLS, MODEL_CALLS, MODEL_IO_WORDS, SAME_BLOCK, SENSITIVE_WORDS,
    SYSTEM_WORDS, USER_WORDS,
)
from .spec import FILE, Pattern, RuleSpec

CODE5 = ("*.py", "*.js", "*.ts", "*.tsx", "*.jsx")
PYTHON = ("*.py",)
JSON = ("*.json",)
IDE_FILES = (".cursorrules", ".windsurfrules")
TOOL_CODE = ("*.py", "*.js", "*.ts", "*.tsx")
SKILL_FILES = ("*.py", "*.js", "*.ts", "*.tsx", "*.md", "*.yaml", "*.yml", "*.toml")
MANIFESTS = ("*.json", "*.yaml", "*.yml", "*.toml")
CODE5_JSON = CODE5 + JSON

# anchor words: lower-case literals taken from the word groups above
_SYSTEM = ("system_prompt", "system_msg", "sys_prompt", "instructions", "base_prompt")
_USER = ("user_input", "user_msg", "user_message", "query", "prompt", "input_text", "message", "question")
_CALLS = (".call(", ".invoke(", ".generate(", ".chat(", ".complete(", ".create(", "openai.", "anthropic.")
_SENSITIVE = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "credential", "private_key", "cert", "access_key",
)
_IO = ("response", "output", "answer", "completion", "messages", "conversation", "chat_history", "llm_result")
_LOG = ("console.log", "print", "logger.", "logging.")

SHIPPED_RULES: tuple[RuleSpec, ...] = (
    RuleSpec(
        "DL-002", "external_no_audit", 0, "medium", ("LLM02",), CODE5,
        "Model data leaves for an outside service without an audit trail",
        "Conversation or model output is sent to an external API with no record of what left and no consent step.",
        "Ask for consent, write an audit record, strip personal data and make the export switchable.",
        (
            Pattern(rf"(requests|httpx|urllib|fetch|axios)\.(post|put)\s*\(.*{MODEL_IO_WORDS}",
                    "model input or output in an outbound HTTP post/put",
                    anchors=((".post", ".put"), _IO)),
            Pattern(r"(langsmith|langfuse|helicone|weights.*biases|wandb|agentops)",
                    "data may go to an AI monitoring vendor",
                    anchors=(("langsmith", "langfuse", "helicone", "weights", "wandb", "agentops"),)),
        ),
    ),
    RuleSpec(
        "DL-001", "log_sensitive", 1, "medium", ("LLM02",), CODE5,
        "Sensitive data written to logs or raw HTML",
        "Secrets, model conversations or whole request objects reach a log, or user data reaches an HTML sink.",
        "Never log secrets, log at most a prefix and a hash of model text, and escape data put into HTML.",
        (
            Pattern(rf"(console\.log|print|logger\.(info|debug|error|warning)|logging\.)\s*\(.*{SENSITIVE_WORDS}",
                    "secret-looking variable in a log call",
                    anchors=(_LOG, _SENSITIVE)),
            Pattern(rf"(console\.log|print|logger\.)\s*\(.*{MODEL_IO_WORDS}",
                    "model conversation in a log call",
                    anchors=(_LOG, _IO)),
            Pattern(r"console\.log\s*\(\s*(JSON\.stringify|json\.dumps)\s*\(\s*(req|request|res|response)\s*\)",
                    "whole request or response object in a log call",
                    anchors=(("console.log",), ("json.",))),
            Pattern(r"dangerouslySetInnerHTML\s*[:=]\s*\{.*__html",
                    "raw HTML injected into a React element",
                    anchors=(("dangerouslysetinnerhtml",),)),
            Pattern(r"\.innerHTML\s*=\s*.*(user|input|query|message|data|content)",
                    "user data assigned to innerHTML",
                    anchors=((".innerhtml",),)),
        ),
    ),
    RuleSpec(
        "FW-002", "unsandboxed_code_exec", 2, "critical", ("LLM06", "AG-10"), PYTHON,
        "Agent runs generated code outside a container",
        "A conversational agent is configured to execute generated code and the container sandbox is not certain.",
        "Set use_docker to True in the execution config, or switch code execution off.",
        (
            Pattern(r"code_execution_config\s*=\s*\{[^}]*\}",
                    "code execution config given: check that the container is on",
                    anchors=(("code_execution_config",),)),
            Pattern(r"(?:ConversableAgent|AssistantAgent)\s*\([^)]*code_execution",
                    "agent constructed with code execution",
                    anchors=(("code_execution",), ("conversableagent", "assistantagent"))),
            Pattern(r"use_docker\s*=\s*False",
                    "container sandbox switched off",
                    anchors=(("use_docker",),)),
        ),
    ),
    RuleSpec(
        "FW-003", "task_code_exec", 3, "high", ("LLM06", "AG-02"), PYTHON,
        "Task or tool runs generated code without checking it",
        "A task allows code execution, or a tool class reaches the shell, with no review of the generated code.",
        "Validate generated code before running it, and run it in an isolated process with a time limit.",
        (
            Pattern(r"allow_code_execution\s*=\s*True",
                    "task allows code execution",
                    anchors=(("allow_code_execution",),)),
            Pattern(rf"class\s+\w*Tool\w*[^\n]*\n{SAME_BLOCK}{{0,500}}?(?:os\.system|subprocess\.)",
                    "tool class with shell access", FILE,
                    anchors=(("os.system", "subprocess."), ("class",))),
        ),
    ),
    RuleSpec(
        "FW-004", "plugin_route_no_auth", 4, "medium", ("AG-03",), PYTHON,
        "Plugin route without a permission check",
        "A plugin exposes an HTTP route and nothing after it looks at the permissions of the caller.",
        "Check the caller's workspace permission in the handler or with a decorator.",
        (
            Pattern(rf"@app\.route[^\n]*\n{SAME_BLOCK}{{0,500}}?def\s+\w+[^\n]*\n{SAME_BLOCK}{{0,500}}?"
                    r"(?!.*?(?:permission|auth|workspace_id|current_user))",
                    "route handler with no permission word after it", FILE,
                    anchors=(("@app.route",),)),
        ),
    ),
    RuleSpec(
        "FW-001", "tool_danger_no_confirm", 5, "high", ("LLM06", "AG-02"), PYTHON,
        "Decorated tool performs a dangerous operation without confirmation",
        "A tool function reaches the shell, deletes files or writes over HTTP and never asks the user.",
        "Add a confirmation callback to the tool or ask inside the function before acting.",
        (
            Pattern(r"@tool", "tool decorator without a confirmation guard",
                    anchors=(("@tool",),)),
            Pattern(rf"def\s+\w+[^\n]*\n{SAME_BLOCK}{{0,500}}?(?:subprocess\.|os\.system|os\.popen)",
                    "shell call inside a function", FILE,
                    anchors=(("subprocess.", "os.system", "os.popen"), ("def",))),
            Pattern(rf"def\s+\w+[^\n]*\n{SAME_BLOCK}{{0,500}}?(?:os\.remove|shutil\.rmtree|Path\(.*\)\.unlink)",
                    "file deletion inside a function", FILE,
                    anchors=(("os.remove", "shutil.rmtree", ".unlink"), ("def",))),
            Pattern(rf"def\s+\w+[^\n]*\n{SAME_BLOCK}{{0,500}}?requests\.(?:post|put|delete|patch)",
                    "outbound HTTP write inside a function", FILE,
                    anchors=(("requests.",), ("def",))),
        ),
    ),
    RuleSpec(
        "MCP-003", "mcp_command_path", 6, "medium", ("LLM06", "AG-02"), JSON,
        "Tool server starts from a user-writable path or a bare shell",
        "The server command points into a project directory or at a shell interpreter, so whoever can write there runs code.",
        "Install the server system-wide, use its absolute path and never make a shell the command.",
        kind="config_command",
    ),
    RuleSpec(
        "MCP-002", "mcp_env_secret", 7, "critical", ("LLM02",), JSON,
        "Tool server config holds a plain-text secret",
        "A value in the server's environment map has the shape of a real key or token instead of a variable reference.",
        "Reference a host variable such as ${NAME} instead of writing the value into the file.",
        kind="config_env",
    ),
    RuleSpec(
        "MCP-004", "tool_description_injection", 8, "high", ("LLM01", "AG-02"), TOOL_CODE,
        "Tool description tries to steer the agent",
        "A tool description or docstring contains wording that overrides, extracts or redirects instructions.",
        "Keep tool descriptions neutral and factual, and screen them like user input.",
        (
            Pattern(DESCRIPTION_PLACES, "tool description with an injection phrase", FILE,
                    anchors=(("description", "def"),)),
        ),
        kind="tool_description",
    ),
    RuleSpec(
        "MCP-001", "mcp_no_auth", 9, "high", ("LLM06", "AG-03"), JSON,
        "Tool server without authentication",
        "Neither headers, environment nor arguments of the server entry hint at any authentication.",
        "Give every server entry an authorization header or a token from the environment.",
        kind="config_auth",
    ),
    RuleSpec(
        "PI-001", "prompt_concat", 10, "high", ("LLM01",), CODE5,
        "User input concatenated into a prompt",
        "Unprocessed user input is joined to the system prompt or to code that is evaluated.",
        "Separate user input with clear markers and tell the model to ignore instructions found inside them.",
        (
            Pattern(rf"f\".*\{{{SYSTEM_WORDS}\}}.*\{{{USER_WORDS}\}}.*\"",
                    "f-string joins system prompt and user input",
                    anchors=(_SYSTEM, _USER, ('f"',))),
            Pattern(rf"{SYSTEM_WORDS}\s*\+\s*{USER_WORDS}",
                    "system prompt + user input",
                    anchors=(_SYSTEM, _USER, ("+",))),
            Pattern(rf"\.format\s*\(\s*.*{USER_WORDS}",
                    "user input passed to format()",
                    anchors=((".format",), _USER)),
            Pattern(rf"%\s*\(?\s*{USER_WORDS}",
                    "user input through % formatting",
                    anchors=(("%",), _USER)),
            Pattern(rf"`.*\$\{{{USER_WORDS}\}}.*`",
                    "template literal with user input",
                    anchors=(("${",), _USER)),
            Pattern(rf"\"\s*\+\s*{USER_WORDS}",
                    "string literal + user input",
                    anchors=(("+",), _USER)),
            Pattern(rf"eval\s*\(\s*{USER_WORDS}",
                    "eval() of user input",
                    anchors=(("eval",), _USER)),
            Pattern(rf"new\s+Function\s*\(.*{USER_WORDS}",
                    "new Function() of user input",
                    anchors=(("function",), _USER)),
        ),
    ),
    RuleSpec(
        "PI-004", "ide_rule_injection", 11, "medium", ("LLM01", "LLM07"), IDE_FILES,
        "Editor rule file carries suspicious directives",
        "A project rule file tells the agent to send data out, leak credentials, hide warnings or drop safety checks.",
        "Review rule files like code and reject external URLs, credential requests and pseudo system tags.",
        (
            Pattern(r"(?:send|upload|forward|post|transmit|submit)\s+.*(?:to\s+)?https?://[^\s\"']{5,}",
                    "sends data to an external URL",
                    anchors=(("http://", "https://"),)),
            Pattern(r"(?:include|attach|append|add)\s+(?:the\s+)?(?:api[_\s]?key|token|secret|password|credential)",
                    "asks for credentials in the output",
                    anchors=(("include", "attach", "append", "add"), ("api", "token", "secret", "password", "credential"))),
            Pattern(r"(?:never|don'?t|do\s+not)\s+(?:show|display|report|flag)\s+(?:warnings?|errors?|security|vulnerab)",
                    "suppresses security warnings",
                    anchors=(("warning", "error", "security", "vulnerab"), ("show", "display", "report", "flag"))),
            Pattern(r"(?:ignore|bypass|override|disable|skip)\s+(?:safety|security|refusal|restriction|guardrail|policy)",
                    "bypasses safety mechanisms",
                    anchors=(("ignore", "bypass", "override", "disable", "skip"), ("safety", "security", "refusal", "restriction", "guardrail", "policy"))),
            Pattern(r"(?:install|use|download|fetch)\s+.*(?:from\s+)?https?://[^\s\"']{5,}",
                    "fetches code from an external URL",
                    anchors=(("http://", "https://"),)),
            Pattern(r"\[SYSTEM\]|\[HIDDEN\]|\[INTERNAL\]|\[OVERRIDE\]",
                    "pseudo system tag",
                    anchors=(("[system]", "[hidden]", "[internal]", "[override]"),)),
        ),
    ),
    RuleSpec(
        "PI-002", "missing_sanitization", 12, "medium", ("LLM01",), CODE5,
        "Model called without cleaning its input",
        "Instruction-override wording is present, or raw user input is handed straight to a model call.",
        "Strip control characters, limit the length and reject known injection wording before the call.",
        (
            Pattern(r"(ignore|忽略|forget|忘记| disregard).*(instructions|指令|prompt|提示)",
                    "instruction-override wording",
                    anchors=(("ignore", "忽略", "forget", "忘记", " disregard"), ("instructions", "指令", "prompt", "提示"))),
            Pattern(rf"{USER_WORDS}\s*\)?\s*\n\s*{MODEL_CALLS}",
                    "raw user input handed to a model call on the next line", FILE,
                    anchors=(_CALLS, _USER)),
        ),
    ),
    RuleSpec(
        "PI-003", "no_system_defense", 13, "medium", ("LLM01", "LLM07"), CODE5,
        "System prompt without a defence clause",
        "A system prompt literal does not tell the model to refuse attempts to override it.",
        "End the system prompt with rules that refuse to ignore, change or reveal it.",
        (
            Pattern(rf"({SYSTEM_WORDS})\s*=\s*[\"'](?!.*(?:忽略|拒绝|ignore|refuse|不要|勿|forbidden|prohibited|must not))",
                    "system prompt literal with no defence word on its line",
                    anchors=(_SYSTEM, ("=",))),
        ),
    ),
    RuleSpec(
        "SC-001", "skill_supply_chain", 14, "critical", ("LLM01", "LLM02", "AG-10"), SKILL_FILES,
        "Skill or plugin with a supply-chain pattern",
        "An agent extension hides an encoded payload, talks to a drop host, reads sensitive files or evaluates its input.",
        "Audit third-party skills before installing, pin and verify them, and sandbox the agent that loads them.",
        (
            Pattern(r"(?:exec|eval|__import__)\s*\(\s*(?:base64\.b64decode|atob|Buffer\.from)\s*\(['\"][A-Za-z0-9+/=]{40,}['\"]",
                    "execution of an encoded literal",
                    anchors=(("b64decode", "atob", "buffer.from"), ("exec", "eval", "__import__"))),
            Pattern(r"(?:importlib|__import__|compile)\s*\(.*(?:b64decode|atob|Buffer\.from|fromCharCode|unescape)",
                    "dynamic import or compile of encoded code",
                    anchors=(("importlib", "__import__", "compile"), ("b64decode", "atob", "buffer.from", "fromcharcode", "unescape"))),
            Pattern(r"(?:requests|httpx|urllib|fetch|axios|node-fetch)\s*\.\s*(?:post|put|get)\s*\(\s*['\"]https?://"
                    rf"(?:[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}|(?:{DROP_HOSTS}))",
                    "HTTP call to a raw address or drop host",
                    anchors=(("http://", "https://"), ("post", "put", "get"))),
            Pattern(r"(?:os\.system|subprocess\.|child_process\.exec|execSync|spawn\s*\(|popen)\s*\(.*"
                    r"(?:decode\s*\(|fromhex|replace\s*\(['\"]\\x|\.join\s*\(.*chr\()",
                    "shell call that decodes its argument",
                    anchors=(("os.system", "subprocess.", "child_process.exec", "execsync", "spawn", "popen"), ("decode", "fromhex", "replace", "chr("))),
            Pattern(r"[\"'](?:description|name|title)[\"']\s*:\s*[\"'].*(?:collect|harvest|gather|scrape|steal|exfiltrate|leak|dump)"
                    r".*(?:email|credential|password|token|key|secret|data)",
                    "metadata announces data harvesting",
                    anchors=(("collect", "harvest", "gather", "scrape", "steal", "exfiltrate", "leak", "dump"), ("description", "name", "title"))),
            Pattern(r"(?:open|readFile|readFileSync|fs\.read)\s*\(.*(?:/etc/|\.env|\.ssh/|\.aws/|\.config/|config\.json"
                    r"|credentials|\.git/config|\.npmrc|\.pypirc)",
                    "sensitive file opened",
                    anchors=(("/etc/", ".env", ".ssh/", ".aws/", ".config/", "config.json", "credentials", ".git/config", ".npmrc", ".pypirc"), ("open", "readfile", "fs.read"))),
            Pattern(r"(?:eval|exec|Function\s*\()\s*\(\s*(?:this\.|obj\.|data\.|config\.|meta\.|input\.|args\.|params\.)",
                    "evaluation of a value taken from skill input",
                    anchors=(("eval", "exec", "function"), ("this.", "obj.", "data.", "config.", "meta.", "input.", "args.", "params."))),
        ),
    ),
    RuleSpec(
        "SC-002", "manifest_suspicious_url", 15, "high", ("AG-10",), MANIFESTS,
        "Manifest points at a paste, raw or request-bin host",
        "A skill manifest references a host that is often used to deliver a second stage after review.",
        "Replace such references with vendored copies and block these hosts for agent tools.",
        (Pattern(DROP_URLS, "URL of a paste, raw or request-bin host",
                    anchors=(("http://", "https://"),)),),
    ),
    RuleSpec(
        "TA-003", "cross_agent_context_loss", 16, "high", ("AG-03", "LLM06"), CODE5,
        "Delegation loses the caller's permissions",
        "A child agent or task is started without the identity or scope of the user who asked for it.",
        "Pass user id, role and scope to every child agent and verify them before privileged work.",
        (
            Pattern(r"(?:\.run\(|\.invoke\(|\.process\(|\.execute\(|create_task\()"
                    r"(?!.*(?:user_id|auth|permission|scope|context|caller))",
                    "call without an identity or permission word after it",
                    anchors=((".run(", ".invoke(", ".process(", ".execute(", "create_task("),)),
            Pattern(r"Task\s*\([^)]*agent\s*=\s*\w+(?!.*context\s*=)(?!.*user_id\s*=)",
                    "task handed to an agent without user context",
                    anchors=(("task",), ("agent",))),
            Pattern(r"(?:initiate_chat|a_initiate_chat)\s*\([^)]*(?!.*carryover\s*=)",
                    "agent chat started without carry-over",
                    anchors=(("initiate_chat",),)),
            Pattern(r"StateGraph\s*\([^)]*\)(?!.*\bauth\b)",
                    "state graph without an auth field",
                    anchors=(("stategraph",),)),
            Pattern(r"(?:createChildAgent|spawnAgent|createAgent)\s*\([^)]*"
                    r"(?!.*(?:userId|auth|permission|scope|context))",
                    "child agent created without permissions",
                    anchors=(("createchildagent", "spawnagent", "createagent"),)),
        ),
    ),
    RuleSpec(
        "TA-001", "high_risk_tool", 17, "high", ("LLM06", "AG-10"), CODE5,
        "High-risk tool without user confirmation",
        "Shell, deletion or process functions are exposed to the agent with no confirmation step.",
        "Require confirmation for every high-risk tool or ask the user inside it.",
        (
            Pattern(r"(def |async def )\w*(shell|bash|exec|delete|remove|write)\w*",
                    "function named after a dangerous action",
                    anchors=(("def ",), ("shell", "bash", "exec", "delete", "remove", "write"))),
            Pattern(r"(os\.system|subprocess\.(call|run|Popen)|os\.popen|commands\.)",
                    "direct shell call",
                    anchors=(("os.system", "subprocess.", "os.popen", "commands."),)),
            Pattern(r"(os\.remove|os\.unlink|shutil\.rmtree|Path\(.*\)\.unlink)",
                    "file deletion",
                    anchors=(("os.remove", ".unlink", "shutil.rmtree"),)),
            Pattern(r"(child_process\.exec|execSync|spawn|exec\s*\(|execFile)",
                    "process start",
                    anchors=(("exec", "spawn"),)),
            Pattern(r"(fs\.(unlink|rm|rmSync|unlinkSync)\s*\(|rimraf\s*\()",
                    "file deletion through the file-system module",
                    anchors=(("fs.unlink", "fs.rm", "rimraf"),)),
            Pattern(r"(fetch|axios)\s*\(\s*[\"'][^\"']*(?:delete|remove|destroy|purge)",
                    "destructive action over HTTP",
                    anchors=(("delete", "remove", "destroy", "purge"), ("fetch", "axios"))),
        ),
    ),
    RuleSpec(
        "TA-002", "missing_permission", 18, "high", ("LLM06", "AG-03"), CODE5,
        "Tool acts without a permission check",
        "Sensitive functions, database writes or client-side tokens are reachable with no check of the caller.",
        "Check the caller's rights at the start of every sensitive tool function.",
        (
            Pattern(r"(def |async def )\w*(admin|user|config|secret|key|token|password|credential)\w*",
                    "function named after a sensitive resource",
                    anchors=(("def ",), ("admin", "user", "config", "secret", "key", "token", "password", "credential"))),
            Pattern(r"(\.execute\(|\.commit\(|\.save\(|\.delete\(|\.update\(|INSERT|DELETE|UPDATE|DROP)",
                    "database write",
                    anchors=((".execute(", ".commit(", ".save(", "insert", "delete", "update", "drop"),)),
            Pattern(r"(\.(create|delete|update|upsert|deleteMany|updateMany)\s*\(|prisma\.\w+\.(create|delete|update))",
                    "write through an object mapper",
                    anchors=((".create", ".delete", ".update", ".upsert"),)),
            Pattern(r"(localStorage|sessionStorage)\.(getItem|setItem)\s*\(\s*[\"'](token|auth|session|user)",
                    "auth token in browser storage",
                    anchors=(("localstorage", "sessionstorage"),)),
        ),
    ),
)

DOCUMENTED_RULES: tuple[RuleSpec, ...] = (
    RuleSpec(
        "SEC-001", "ai_provider_key", 19, "critical", ("LLM02",), CODE5_JSON,
        "AI provider key in source",
        "A literal with the shape of an AI provider API key is written into the source.",
        "Load the key from the environment or a secret store and rotate the leaked one.",
        (Pattern(r"\bsk-[A-Za-z0-9_-]{20,}", "AI provider key literal",
                    anchors=(("sk-",),)),),
    ),
    RuleSpec(
        "SEC-002", "cloud_credential", 20, "critical", ("LLM02",), CODE5_JSON,
        "Cloud credential in source",
        "A literal with the shape of a cloud access key is written into the source.",
        "Use instance roles or a secret store and rotate the leaked key.",
        (Pattern(r"\bAKIA[A-Z0-9]{16}\b", "cloud access key literal",
                    anchors=(("akia",),)),),
    ),
    RuleSpec(
        "SEC-003", "generic_secret", 21, "high", ("LLM02",), CODE5_JSON,
        "Password, token or database URL in source",
        "A variable named after a secret is assigned a literal, or a database URL carries a password.",
        "Move the value to the environment or a secret store.",
        (
            Pattern(r"(password|passwd|secret|token|api_key|apikey|private_key|auth_token|access_key)[\"']?\s*[=:]\s*[\"'][^\s\"']{8,}[\"']",
                    "secret-named variable assigned a literal",
                    anchors=(("passw", "secret", "token", "api_key", "apikey", "private_key", "access_key"), ("=", ":"))),
            Pattern(r"[a-z][a-z0-9+]{1,15}://[^\s:/@\"']+:[^\s:/@\"']+@[^\s\"']+", "URL with an embedded password",
                    anchors=(("://",), ("@",))),
        ),
    ),
)

ALL_RULES: tuple[RuleSpec, ...] = SHIPPED_RULES + DOCUMENTED_RULES
_BY_ID = {r.rule_id: r for r in ALL_RULES}


def rule(rule_id: str) -> RuleSpec:
    return _BY_ID[rule_id]
