"""Fixed values.

Everything here must equal the values users of the workflow rely on today (word
lists, thresholds, prompts, schemas, recipes); nothing here is logic.
"""

# --- quality score -------------------------------------------------------------
QUALITY_EXCELLENT = 0.85
QUALITY_GOOD = 0.60
QUALITY_POOR = 0.35
MAX_IMPROVEMENT_ATTEMPTS = 1
MINIMUM_IMPROVEMENT = 0.05
ABSENT_TEXTS = ["", "N/A", "null", "undefined", "None", "-"]
GARBAGE_PHRASES = [
    "lorem ipsum",
    "placeholder",
    "test data",
    "click here",
    "read more",
    "loading...",
]
IDENTITY_FIELDS = ["url", "title", "name", "headline"]
SCORE_WEIGHTS = {
    "fill_rate": 0.25,
    "basic_validity": 0.20,
    "uniqueness": 0.15,
    "content_quality": 0.10,
    "deterministic_validation": 0.20,
    "result_count": 0.10,
}

# --- profiles ------------------------------------------------------------------
DEFAULT_WAIT_SECONDS = 2.0
WAIT_STEP_UP, WAIT_CAP = 2.0, 15.0
WAIT_STEP_DOWN, WAIT_FLOOR = 0.5, 1.0
AVERAGE_ALPHA = 0.3

# --- page cleaning -------------------------------------------------------------
DROPPED_TAGS = [
    "script", "style", "noscript", "svg", "iframe", "nav", "footer", "header", "aside",
]
OVERLAY_CLASSES = ["cookie", "consent", "modal", "popup", "overlay", "gdpr"]
OVERLAY_CLASSES_COMPAT = [
    "cookie", "consent", "modal", "popup", "overlay", "banner", "gdpr",
]
HIDDEN_STYLE = r"display\s*:\s*none"
NOISE_CLASS = r"(?:^|[-_])(ad|advert|promo|sponsor|newsletter|related|recommend)(?:$|[-_])"
NOISE_REASON = "Repeated likely-noise blocks correlated with poor output"
EXPLICIT_REASON = "Explicit user feedback"
EXPLICIT_EVIDENCE = "explicit-feedback"
RULE_TYPES = ["class", "id", "tag"]
CHALLENGE_MARKERS = [
    ("awswaf-captcha", "aws_waf"),
    ("challenge-platform", "cloudflare"),
    ("cf-chl-", "cloudflare"),
    ("g-recaptcha", "captcha"),
    ("hcaptcha", "captcha"),
]
THIN_PAGE_CHARS = 50
CONTENT_CHARS = 50_000
REDUCED_CONTENT_CHARS = 25_000
QUESTION_CHARS = 30_000
REFINEMENT_SAMPLE_CHARS = 5_000
REFINEMENT_PROMPT_CHARS = 3_000

# --- model requests ------------------------------------------------------------
EXTRACTION_PROMPT = (
    "You are a precise data extraction engine. "
    "Extract structured data from the provided content. "
    "Output only a valid JSON array of objects matching this schema:\n"
)
INSTRUCTIONS_HEADING = "\n\nAdditional instructions:\n"
ACCEPTED_HEADING = "[Accepted domain-specific refinement]"
CANDIDATE_HEADING = "[Candidate retry instructions]"
QUESTION_PROMPT = "Answer the question using only the supplied page content."
REFINEMENT_PROMPT_OPENING = (
    "Analyze this extraction and propose concise retry instructions."
)
REFINEMENT_PROMPT_CLOSING = "Return only the improved extraction instructions."
RETRY_INSTRUCTIONS = {
    "NO_RESULTS": (
        "Look for repeated content records after dynamic rendering. "
        "Return an empty array if no matching records exist."
    ),
    "LOW_FILL_RATE": (
        "Previous output omitted schema fields. Search for synonymous "
        "labels and use null only when the source truly omits a value."
    ),
    "GARBAGE_CONTENT": (
        "Ignore navigation, promotions, newsletters, related content, "
        "and placeholders. Extract only records matching the schema."
    ),
    "MANY_DUPLICATES": (
        "Return each source record once, preferring its canonical URL."
    ),
}
NO_RESULTS_EXTRA_WAIT = 3.0
LINK_FIELDS = ["url", "image_url", "link"]
LINK_FIELDS_COMPAT = ["url", "image_url", "link", "website"]
ADVICE_LOW_SUCCESS = "Inspect authentication, challenge, and rendering requirements."
ADVICE_LOW_FILL = "Review the domain-specific schema field labels."

# --- field schemas -------------------------------------------------------------
SCHEMAS = {
    "APARTMENTS": {
        "title": "Listing title / headline",
        "price": "Monthly rent price with currency",
        "rooms": "Number of rooms",
        "size": "Apartment size in m² or sqft",
        "address": "Full address or neighborhood",
        "url": "Direct link to the listing",
        "image_url": "Main image URL",
        "available_from": "Move-in date if mentioned",
    },
    "REAL_ESTATE_AGENTS": {
        "name": "Agent or agency name",
        "phone": "Phone number",
        "email": "Email address",
        "website": "Website URL",
        "address": "Office address",
        "working_hours": "Office hours or availability",
        "specialty": "Area of expertise (e.g., rental, commercial, luxury)",
    },
    "JOB_LISTINGS": {
        "title": "Job title",
        "company": "Company name",
        "location": "Job location",
        "salary": "Salary range if listed",
        "type": "Full-time, part-time, contract, remote",
        "url": "Link to job posting",
        "posted_date": "When the job was posted",
        "description_summary": "Brief 1-2 sentence summary of the role",
    },
    "PRODUCTS": {
        "name": "Product name",
        "price": "Current price with currency",
        "original_price": "Original price before discount (if any)",
        "rating": "Star rating (e.g., 4.5/5)",
        "reviews_count": "Number of reviews",
        "url": "Link to the product page",
        "image_url": "Product image URL",
        "in_stock": "Whether the item is in stock (true/false)",
    },
    "ARTICLES": {
        "headline": "Article headline",
        "author": "Author name",
        "published_date": "Publication date",
        "summary": "Brief 2-3 sentence summary",
        "url": "Link to the full article",
        "category": "Topic category (politics, tech, sports, etc.)",
    },
    "PROFILES": {
        "name": "Person's name",
        "title": "Professional title or role",
        "company": "Current company or affiliation",
        "location": "City or country",
        "bio": "Brief bio or description",
        "url": "Profile URL",
    },
    "EVENTS": {
        "name": "Event name",
        "date": "Event date and time",
        "location": "Venue or address",
        "price": "Ticket price or 'Free'",
        "url": "Event page URL",
        "description": "Brief event description",
    },
    "RESTAURANTS": {
        "name": "Restaurant name",
        "cuisine": "Type of cuisine",
        "rating": "Rating (e.g., 4.5/5)",
        "price_range": "Price level (€, €€, €€€)",
        "address": "Restaurant address",
        "phone": "Phone number",
        "url": "Restaurant page URL",
    },
    "LINKS": {
        "text": "Link text",
        "url": "Link URL",
        "context": "Surrounding text or description",
    },
    "CONTACTS": {
        "name": "Person or business name",
        "phone": "Phone number",
        "email": "Email address",
        "address": "Physical address",
        "website": "Website URL",
    },
}

# --- redaction -----------------------------------------------------------------
BEARER = r"\bbearer\s+[A-Za-z0-9._~+/-]+"
SECRET_ASSIGNMENT = (
    r"\b(api[_-]?key|token|authorization|password|cookie)\s*[:=]\s*([^\s,;]+)"
)
SECRET_PREFIX = r"\b(?:sk|ghp|gho|xoxb|xoxp)-?[A-Za-z0-9_-]{12,}\b"

# --- failures and recovery -----------------------------------------------------
CRASH_TYPES = [
    "BrowserCrashedError", "InvalidSessionIdException", "NoSuchWindowException",
    "WebDriverException",
]
# TimeoutError and ConnectionError also stand for their built-in subclasses.
NETWORK_TYPES = [
    "NetworkFetchError", "TimeoutError", "ConnectionError", "BrokenPipeError",
    "ConnectionAbortedError", "ConnectionRefusedError", "ConnectionResetError",
    "TimeoutException", "ReadTimeout", "ConnectTimeout",
]
PARSE_TYPES = ["LLMParseError", "JSONDecodeError"]
TIMEOUT_STATUSES = [408, 504]
# scenario: (max attempts, escalation policy, [(step, params, description)])
RECIPES = {
    "network_timeout": (3, "log_and_continue", [
        ("retry_with_backoff", {"max_wait": 30, "base_delay": 2}, "Bounded network backoff"),
        ("retry_request", {}, "Retry the fetch"),
    ]),
    "rate_limited": (2, "alert_human", [
        ("wait_cooldown", {"duration": 60}, "Respect provider cooldown"),
        ("retry_request", {}, "Retry after cooldown"),
    ]),
    "captcha_blocked": (1, "alert_human", [
        ("skip_and_log", {}, "Pause and escalate unsupported CAPTCHA"),
    ]),
    "cloudflare_challenge": (1, "alert_human", [
        ("skip_and_log", {}, "Pause and escalate unsupported Cloudflare challenge"),
    ]),
    "llm_extraction_failed": (2, "log_and_continue", [
        ("reduce_content", {"max_chars": 25_000}, "Reduce the next LLM input"),
        ("retry_request", {}, "Retry extraction"),
    ]),
    "llm_provider_error": (2, "abort", [
        ("retry_with_backoff", {"max_wait": 15, "base_delay": 1}, "Bounded provider backoff"),
        ("retry_with_fallback_model", {}, "Select the configured fallback model"),
        ("retry_request", {}, "Retry extraction"),
    ]),
    "stale_selector": (2, "log_and_continue", [
        ("increase_wait", {"additional_seconds": 3}, "Increase the next browser wait"),
        ("retry_request", {}, "Retry the fetch"),
    ]),
    "empty_page": (2, "alert_human", [
        ("increase_wait", {"additional_seconds": 5}, "Increase the next browser wait"),
        ("clear_cookies", {}, "Clear cookies and browser storage"),
        ("restart_browser", {}, "Restart the browser session"),
        ("retry_request", {}, "Retry from scratch"),
    ]),
    "browser_crash": (2, "abort", [
        ("restart_browser", {}, "Restart the browser session"),
        ("retry_request", {}, "Retry the fetch"),
    ]),
    "json_parse_error": (2, "log_and_continue", [
        ("reduce_content", {"max_chars": 25_000}, "Reduce input before retrying JSON extraction"),
        ("retry_request", {}, "Retry extraction"),
    ]),
    "unknown": (1, "alert_human", [
        ("skip_and_log", {}, "Unknown failure requires operator review"),
    ]),
}
STEP_DETAILS = {
    "increase_wait": "Browser wait updated",
    "reduce_content": "LLM content limit updated",
    "retry_request": "Caller will execute and verify one retry",
    "skip_and_log": "Automatic challenge handling is disabled by policy",
    "restart_browser": "Browser session restarted",
    "clear_cookies": "Browser state cleared",
    "retry_with_fallback_model": "Fallback model selected",
}
NO_FALLBACK_MODEL = "No fallback model configured"
SAME_FALLBACK_MODEL = "Fallback model is already active"
RETRY_SUCCEEDED = "Subsequent retry completed successfully"

# --- command audit -------------------------------------------------------------
WRITE_COMMANDS = (
    "cp mv rm mkdir rmdir touch chmod chown chgrp ln install tee truncate shred "
    "mkfifo mknod dd"
).split()
STATE_MODIFYING_COMMANDS = (
    "apt apt-get yum dnf pacman brew pip pip3 npm yarn pnpm bun cargo gem go rustup "
    "docker systemctl service mount umount kill pkill killall reboot shutdown halt "
    "poweroff useradd userdel usermod groupadd groupdel crontab at"
).split()
READ_ONLY_COMMANDS = (
    "ls cat head tail less more wc sort uniq grep egrep fgrep find which whereis "
    "whatis man info file stat du df free uptime uname hostname whoami id groups env "
    "printenv echo printf date cal bc expr test true false pwd tree diff cmp md5sum "
    "sha256sum sha1sum xxd od hexdump strings readlink realpath basename dirname seq "
    "yes tput column jq yq xargs tr cut paste awk sed dir type where findstr "
    "Get-Content Get-ChildItem Get-Location Get-Date Get-Process Get-Service"
).split()
NETWORK_COMMANDS = (
    "curl wget ssh scp rsync ftp sftp nc ncat telnet ping traceroute tracert dig "
    "nslookup host whois ifconfig ip netstat ss nmap Invoke-WebRequest "
    "Invoke-RestMethod Test-Connection"
).split()
PROCESS_COMMANDS = (
    "kill pkill killall ps top htop bg fg jobs nohup disown wait nice renice "
    "Stop-Process Start-Process taskkill tasklist"
).split()
PACKAGE_COMMANDS = (
    "apt apt-get yum dnf pacman brew pip pip3 npm yarn pnpm bun cargo gem go rustup "
    "snap flatpak choco winget scoop"
).split()
SYSTEM_ADMIN_COMMANDS = (
    "sudo su chroot mount umount fdisk parted lsblk blkid systemctl service journalctl "
    "dmesg modprobe insmod rmmod iptables ufw firewall-cmd sysctl crontab at useradd "
    "userdel usermod groupadd groupdel passwd visudo runas Set-ExecutionPolicy "
    "New-NetFirewallRule"
).split()
ALWAYS_DESTRUCTIVE = ["shred", "wipefs"]
GIT_READ_ONLY_SUBCOMMANDS = (
    "status log diff show branch tag stash remote fetch ls-files ls-tree cat-file "
    "rev-parse describe shortlog blame bisect reflog config"
).split()
GIT_NETWORK_SUBCOMMANDS = ["push", "force-push"]
WRITE_REDIRECTIONS = [">", ">>", ">&"]
DESTRUCTIVE_PATTERNS = [
    ("rm -rf /", "Recursive forced deletion at root — will destroy the system"),
    ("rm -rf ~", "Recursive forced deletion of home directory"),
    ("rm -rf *", "Recursive forced deletion of all files in current directory"),
    ("rm -rf .", "Recursive forced deletion of current directory"),
    ("mkfs", "Filesystem creation will destroy existing data on the device"),
    ("dd if=", "Direct disk write — can overwrite partitions or devices"),
    ("> /dev/sd", "Writing to raw disk device"),
    ("chmod -R 777", "Recursively setting world-writable permissions"),
    ("chmod -R 000", "Recursively removing all permissions"),
    (":(){ :|:& };:", "Fork bomb — will crash the system"),
    ("Format-Volume", "Volume formatting will destroy all data"),
    ("Remove-Item -Recurse -Force C:\\", "Recursive forced deletion of system drive"),
    ("del /s /q C:\\", "Recursive deletion of system drive"),
    ("rd /s /q C:\\", "Recursive deletion of system drive"),
]
SYSTEM_PATHS = [
    "/etc/", "/usr/", "/var/", "/boot/", "/sys/", "/proc/", "/dev/", "/sbin/", "/lib/",
    "/opt/", "C:\\Windows\\", "C:\\Program Files\\", "C:\\System32\\",
]
AUDIT_REASONS = {
    "empty": "Empty command",
    "custom_blocklist": "Command '{0}' is in the custom blocklist",
    "destructive_pattern": "Destructive command detected: {0}",
    "always_destructive": (
        "Command '{0}' is inherently destructive and may cause data loss"
    ),
    "recursive_deletion": (
        "Recursive forced deletion detected — verify the target path is correct"
    ),
    "write_command": (
        "Command '{0}' modifies the filesystem and is not allowed in read-only mode"
    ),
    "state_command": (
        "Command '{0}' modifies system state and is not allowed in read-only mode"
    ),
    "redirection": (
        "Command contains write redirection '{0}' which is not allowed in read-only mode"
    ),
    "git_subcommand": (
        "Git subcommand '{0}' modifies repository state and is not allowed in read-only mode"
    ),
    "system_path": (
        "Command targets system path '{0}' outside the workspace — requires elevated permission"
    ),
    "sed_in_place": "sed -i (in-place editing) is not allowed in read-only mode",
    "traversal": (
        "Command contains directory traversal pattern '../' — "
        "verify the target path resolves within the workspace"
    ),
    "home": (
        "Command references home directory — verify it stays within the workspace scope"
    ),
}

# --- schemas -------------------------------------------------------------------
CUSTOM_DESCRIPTION = "The {} value"
UNKNOWN_SCHEMA = "Unknown schema '{}'. Available: {}"
NO_FIELDS = "fields must contain at least one name"
