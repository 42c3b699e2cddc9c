"""Word lists, weights, patterns and limits the results depend on."""

# Whitespace as Unicode knows it: one property test in Java, and the same set spelled out for RE2.
WS = r"[\p{IsWhite_Space}\x1C-\x1F]"
WS_RE2 = r"[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS_CODES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
WS_CHARS = "".join(map(chr, WS_CODES))
WORD_CHAR = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"

# --- sources -----------------------------------------------------------------
# Fixed values.
CORPUS_EXTENSIONS = ["pdf", "docx", "doc", "txt", "md", "html", "csv", "json"]
UPLOAD_EXTENSIONS = ["pdf", "txt", "md", "html", "htm", "csv", "json", "docx"]
MAX_FILE_BYTES = 100 * 1024 * 1024
MAX_TEXT_CHARS = 10 * 1024 * 1024
VECTOR_BATCH = 100
CONTENT_CUT, HEADING_CUT, ENTITIES_CUT, TOPICS_CUT, SUMMARY_CUT = 500, 100, 200, 100, 200

# --- chunking ----------------------------------------------------------------
# Fixed values.
TARGET_CHARS, MAX_CHARS, MIN_CHARS, OVERLAP_CHARS = 1000, 8000, 100, 200
GREEDY_MAX, GREEDY_OVERLAP = 750, 100
# (document longer than, chunk size, overlap), longest first
SIZE_STEPS = [(500_000, 600, 75), (100_000, 700, 90), (-1, 750, 100)]
TRANSITION_MARKERS = [
    "however", "meanwhile", "furthermore", "moreover", "nevertheless",
    "in contrast", "on the other hand", "in addition", "consequently",
    "therefore", "thus", "as a result", "in conclusion", "finally",
    "first", "second", "third", "next", "then", "later", "afterwards",
]
TIME_MARKERS = ["the next day", "later that", "meanwhile", "suddenly", "then", "after"]
SPEAKER_START = r"^[A-Z][a-z]+ (said|asked|replied|answered|shouted|whispered)"
SPEAKER_QUOTE = r'^"[^"]*"[,.]? [A-Z][a-z]+ (said|asked)'
REFERENCE_STARTS = ["he", "she", "it", "they", "this", "that", "these", "those"]
CONTINUATION_STARTS = ["and", "but", "however", "therefore", "thus", "moreover"]
CONCLUSION_WORDS = ["therefore", "thus", "in conclusion", "finally", "as a result"]
TOPIC_STARTS = ["first", "second", "next", "another", "furthermore", "moreover"]
SECTION_KEYWORDS = ["introduction", "conclusion", "summary", "overview", "key", "important", "main"]

# --- description -------------------------------------------------------------
# Fixed values.
HEADING_MARKERS = ["chapter", "section", "part"]
OPENING_MARKERS = ["once upon", "long ago", "in the beginning"]
ACTION_MARKERS = ["suddenly", "then", "meanwhile", "after"]
DESCRIPTION_MARKERS = ["he was", "she was", "they were", "appeared to be"]
QUESTION_MARKERS = ["how", "what", "why", "problem"]
ENTITY_STOP_WORDS = ["The", "This", "That", "Then", "When", "Where", "What", "How", "Why"]
TOPIC_KEYWORDS = {
    "magic": ["magic", "spell", "enchant", "wizard", "fairy", "potion"],
    "adventure": ["journey", "quest", "travel", "explore", "adventure"],
    "romance": ["love", "heart", "marry", "wedding", "kiss"],
    "conflict": ["fight", "battle", "war", "enemy", "defeat"],
    "mystery": ["secret", "hidden", "mystery", "unknown", "discover"],
    "family": ["father", "mother", "son", "daughter", "family"],
    "nature": ["forest", "sea", "mountain", "river", "tree"],
    "royalty": ["king", "queen", "prince", "princess", "castle"],
}
TYPE_WEIGHTS = {
    "dialogue": 1.3, "narrative_opening": 1.4, "question": 1.2,
    "action": 1.1, "description": 0.9, "paragraph": 1.0,
}
CHUNK_KEYWORDS = ["important", "key", "summary", "conclusion", "result", "finding"]
KEYWORD_STOP_WORDS = ["the", "a", "an", "but", "in", "on", "at", "to", "for", "by"]
FOLLOW_UPS = [
    "Can you explain more about that?",
    "What are the benefits of this approach?",
    "Are there any alternatives?",
    "How does this compare to other options?",
]
EMBED_TEXT_CHARS = 3000

# --- search ------------------------------------------------------------------
# Fixed values.
BOOSTED_TYPES = ["dialogue", "question", "narrative_opening"]
SINGLE_STAGE_THRESHOLD = 0.45
BM25_K1, BM25_B = 1.5, 0.75
SEMANTIC_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
HYBRID_POOL, HYBRID_EXPANSION = 50, 3
SPECIFIC_WORDS = ["who", "what", "when", "where", "why", "how"]
COMPARE_WORDS = ["compare", "versus", "vs", "difference", "similar", "like"]
TEMPORAL_WORDS = ["before", "after", "during", "when", "time", "date", "year"]
CONTENT_COMPARE_WORDS = ["than", "more", "less", "better", "worse", "similar", "different"]
CONTENT_TEMPORAL_WORDS = ["year", "time", "date", "before", "after", "during", "when"]
# complexity: (stage-1 threshold, final threshold, expansion)
STAGE_PLAN = {"simple": (0.4, 0.6, 2), "medium": (0.4, 0.6, 3), "complex": (0.25, 0.4, 4)}

# --- prompt ------------------------------------------------------------------
# Fixed values.
CONTEXT_INTRO = "Here is some relevant information that might help answer the question:"
ANSWER_RULE = (
    "Please provide a brief, conversational response (2-3 sentences max) based on the information provided. "
    "Be direct and helpful. If the information doesn't contain the answer, just say you don't have enough "
    "information to answer accurately."
)
RAG_INDICATORS = [
    "Context:", "Here is some relevant information", "Document",
    "based on the information provided", "relevant documents", "retrieved context",
]
CACHE_MODELS = [
    "anthropic.claude-sonnet-4-20250514-v1:0", "anthropic.claude-3-5-haiku-20241022-v1:0",
    "amazon.nova-lite-v1:0", "amazon.nova-pro-v1:0",
]

# --- screening ---------------------------------------------------------------
# Fixed values.
UNSAFE_INPUT = [
    r"(<script|javascript:|onclick=|onerror=)",
    r"(eval\(|setTimeout\(|setInterval\()",
    r"(\$\{|`\$\{)",
]
UNSAFE_FRAME = [
    r"<script\b[^<]*(?:(?!</script>)<[^<]*)*</script>", r"javascript:", r"on\w+\s*=", r"data:text/html",
]
MAX_MESSAGE, MAX_FRAME = 2000, 4000
XSS_PATTERNS = [
    r"<script", r"javascript:", r"vbscript:", r"on\w+\s*=", r"expression\s*\(", r"eval\s*\(",
    r"setTimeout\s*\(", r"setInterval\s*\(", r"<iframe", r"<object", r"<embed", r"<form",
    r"<input", r"<textarea", r"<select", r"<button",
]
SPAM_REPEAT = r"(.)\1{10,}"
SPAM_SPECIAL = r"^[^a-zA-Z0-9\s]{20,}$"
SPAM_URL = r"(?i)https?://[^\s]+"
PROFANE_WORDS = ["fuck", "shit", "damn", "bitch", "asshole", "bastard"]
SPAM_INJECTION = [r"<script", r"javascript:", r"on\w+\s*=", r"eval\s*\(", r"expression\s*\("]
# ordered removals for markup
MARKUP_REMOVALS = [
    r"(?i)<script\b[^<]*(?:(?!</script>)<[^<]*)*</script>",
    r"(?i)javascript:",
    r"(?i)data:(?!image/(?:png|jpg|jpeg|gif|svg\+xml);base64,)",
    r"(?i)vbscript:",
    r"""(?i)\s*on\w+\s*=\s*["'][^"']*["']""",
    r"(?i)\s*on\w+\s*=\s*[^>\s]+",
    r"(?i)expression\s*\(",
    r"(?i)-moz-binding",
    r"(?i)@import",
    r"(?i)\beval\s*\(",
    r"(?i)\bsetTimeout\s*\(",
    r"(?i)\bsetInterval\s*\(",
    r"(?i)\bFunction\s*\(",
    r"(?i)&#(?!39;)x?[0-9a-f]+;?",
]
MODERATION_MIN_CHARS = 18
DOCUMENT_KEYWORDS = [
    "document", "file", "pdf", "upload", "attachment",
    "content", "text", "page", "section", "chapter",
    "what does the document say", "according to the document",
    "in the file", "from the document", "document contains",
]
CACHE_SENSITIVE = [
    "password", "secret_key", "api_key", "credential", "private_data",
    "confidential", "auth_token", "access_key", "ssn", "credit_card",
]
REQUEST_SENSITIVE = ["credential", "password", "secret", "token", "key"]
LOG_SENSITIVE = [
    "password", "secret", "key", "token", "credential",
    "auth", "private", "confidential", "ssn", "credit",
    "card", "api_key", "access_token", "refresh_token",
]

# --- cost --------------------------------------------------------------------
# Model, price per 1,000 input tokens, price per 1,000 output tokens.
PRICES = [("amazon.nova-lite-v1", 0.00006, 0.00024), ("amazon.titan-embed-text-v1", 0.0001, 0.0)]
VECTOR_QUERY_PRICE = 0.0004
STORAGE_GB_MONTH = 0.06
QUERY_API_PER_1K, QUERY_TB = 0.0025, 0.004
DAILY_COST_ALARM, CONVERSATION_COST_ALARM, ERROR_ALARM = 5.0, 0.10, 10
METRIC_BATCH = 20
MAX_CALLS_PER_MINUTE = 150
CACHE_TTL_SECONDS = {
    "response": 7200, "vector_query": 7200, "metadata": 7200, "config": 7200,
    "prompt": 3600, "context": 3600, "guardrail": 3600,
}
WIDGET_TTL_SECONDS = 8 * 3600
VECTOR_MB = 0.006
RETENTION_DAYS = 90

# --- logs --------------------------------------------------------------------
# Error type, status code, message for the user.
ERROR_DIMENSION = [
    ("VALIDATION_ERROR", 400, "Please check your input and try again."),
    ("AUTHENTICATION_ERROR", 401, "Authentication failed. Please check your credentials."),
    ("AUTHORIZATION_ERROR", 403, "You don't have permission to perform this action."),
    ("RATE_LIMIT_ERROR", 429, "Too many requests. Please wait a moment and try again."),
    ("DATABASE_ERROR", 500, "We're experiencing technical difficulties. Please try again later."),
    ("BEDROCK_ERROR", 502, "AI service is temporarily unavailable. Please try again later."),
    ("WEBSOCKET_ERROR", 500, "Connection error occurred. Please refresh and try again."),
    ("EXTERNAL_SERVICE_ERROR", 502, "External service is temporarily unavailable. Please try again later."),
    ("CONFIGURATION_ERROR", 500, "Service configuration error. Please contact support."),
    ("SIGNING_ERROR", 500, "Request authentication failed. Please try again."),
    ("INTERNAL_SERVER_ERROR", 500, "An unexpected error occurred. Please try again later."),
]
DEFAULT_STATUS = 500
DEFAULT_ERROR_MESSAGE = "An unexpected error occurred. Please try again later."
# pattern, type, title; service patterns before system patterns
LOG_SIGNATURES = [
    ("InvalidUserID.NotFound", "aws_user_not_found", "AWS User Not Found"),
    ("SignatureDoesNotMatch", "aws_signature_error", "AWS Signature Error"),
    ("AccessDenied", "aws_permissions", "Insufficient AWS Permissions"),
    ("TokenRefreshRequired", "aws_token_expired", "AWS Session Token Expired"),
    ("LimitExceeded", "aws_quota_limit", "AWS Service Limit Exceeded"),
    ("InsufficientCapacity", "aws_capacity", "Insufficient AWS Capacity"),
    ("ValidationException.*Template format error", "cdk_template_error", "CDK Template Error"),
    ("is not authorized to perform.*on resource", "cdk_permissions", "CDK Permission Error"),
    ("ConnectTimeoutError", "network_timeout", "Network Connection Timeout"),
    ("EndpointConnectionError", "network_endpoint", "AWS Endpoint Connection Error"),
    ("InvalidParameterValue.*not supported", "service_not_supported", "Service Not Supported in Region"),
    ("ModuleNotFoundError", "python_module_missing", "Python Module Missing"),
    ("Permission denied", "permission_denied", "Permission Denied"),
    ("command not found", "command_not_found", "Command Not Found"),
]
# Description and solutions by error type; a mapping where they depend on the system.
SIGNATURE_ADVICE = {
    "aws_user_not_found": ("The AWS user specified in your credentials doesn't exist", [
        "Check your AWS Access Key ID is correct", "Verify the user exists in AWS IAM console", "Run 'aws configure' to update credentials"]),
    "aws_signature_error": ("Your AWS Secret Access Key is incorrect", [
        "Run 'aws configure' and enter the correct Secret Access Key", "Check for extra spaces or characters in your key",
        "Generate a new Access Key pair in AWS IAM console"]),
    "aws_permissions": ("Your AWS user doesn't have required permissions", [
        "Ask your AWS admin to attach 'AdministratorAccess' policy",
        "Or attach these specific policies: IAM, CloudFormation, Lambda, S3, RDS, API Gateway", "Check if your account has MFA requirements"]),
    "aws_token_expired": ("Your temporary AWS credentials have expired", [
        "If using AWS SSO, run 'aws sso login'", "If using temporary credentials, refresh them",
        "Consider using long-term Access Keys for deployment"]),
    "aws_quota_limit": ("You've hit an AWS service limit or quota", [
        "Check AWS Service Quotas console for current limits", "Request a quota increase if needed", "Try deploying in a different region",
        "Clean up unused resources"]),
    "aws_capacity": ("AWS doesn't have enough capacity in this region", [
        "Try again in a few minutes", "Deploy to a different availability zone", "Consider using a different instance type",
        "Try a different AWS region"]),
    "cdk_template_error": ("There's an error in the CloudFormation template", [
        "Update AWS CDK to the latest version: npm install -g aws-cdk", "Run 'cdk doctor' to check for issues",
        "Try 'cdk bootstrap' if not already done", "Check if your region supports all required services"]),
    "cdk_permissions": ("CDK doesn't have permission to create/modify resources", [
        "Ensure your AWS user has CloudFormation permissions", "Check if there are resource-based policies blocking access",
        "Verify your account isn't in an organization with restrictive SCPs"]),
    "network_timeout": ("Cannot connect to AWS services", [
        "Check your internet connection", "Verify firewall isn't blocking AWS endpoints", "Try using a different network",
        "Check if you're behind a corporate proxy"]),
    "network_endpoint": ("Cannot reach AWS service endpoints", [
        "Check if the AWS region is correct", "Verify the service is available in your region", "Check DNS resolution for AWS endpoints",
        "Try using AWS CLI with --debug flag for more info"]),
    "service_not_supported": ("The requested service/feature isn't available in your region", [
        "Try a different AWS region (us-east-1 has most services)", "Check AWS service availability by region",
        "Use alternative services if available", "Contact AWS support for service availability"]),
    "python_module_missing": ("Required Python package is not installed", [
        "Run 'pip3 install -r requirements.txt'", "Check if you're in the correct directory", "Verify Python virtual environment is activated",
        "Try 'pip3 install --upgrade pip' first"]),
    "permission_denied": ("Insufficient permissions to perform operation", {
        "windows": ["Run Command Prompt as Administrator", "Check file/folder permissions", "Ensure you have write access to the directory"],
        "": ["Try running with 'sudo' if appropriate", "Check file permissions with 'ls -la'",
             "Ensure you own the files: 'sudo chown -R $USER:$USER .'", "Make scripts executable: 'chmod +x chatbot'"]}),
    "command_not_found": ("Required command/tool is not installed or not in PATH", {
        "darwin": ["Install missing tools with Homebrew: 'brew install <tool>'", "Check if Xcode Command Line Tools are installed",
                   "Update your PATH environment variable", "Restart your terminal after installation"],
        "linux": ["Install with package manager: 'sudo apt install <tool>' or 'sudo yum install <tool>'",
                  "Check if the tool is in your PATH: 'which <command>'", "Update package lists: 'sudo apt update'",
                  "Install build tools if needed: 'sudo apt install build-essential'"],
        "": ["Install from official website or use package manager", "Add installation directory to PATH environment variable",
             "Restart Command Prompt after installation", "Consider using Windows Subsystem for Linux (WSL)"]}),
}
GENERIC_INDICATORS = ["ERROR:", "Error:", "Exception:", "Failed:", "FAILED:"]
RETRYABLE_INGEST_NAMES = [
    "throttlingexception", "serviceunavailableexception", "internalservererror",
    "timeout", "connectionerror", "temporaryerror",
]
RETRYABLE_INGEST_WORDS = ["throttl", "timeout", "connection", "temporary"]
RETRYABLE_CALL_NAMES = [
    "ThrottlingException", "ServiceUnavailableException", "InternalServerException",
    "TooManyRequestsException", "ClientError",
]
RETRYABLE_CALL_WORDS = ["throttling", "throttled", "timeout", "connection", "limit exceeded", "too many requests"]
