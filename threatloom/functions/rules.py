"""Rule data: word lists, patterns and thresholds of the filters and validators."""

# Relevance scoring. (group, score, terms)
POSITIVE = [
    ("critical", 30, ["zero-day", "0-day", "critical vulnerability", "rce", "remote code execution", "ransomware attack", "data breach", "security breach", "cyber attack", "cyberattack"]),
    ("high", 20, ["vulnerability", "exploit", "breach", "ransomware", "malware", "trojan", "backdoor", "apt", "advanced persistent threat", "compromise", "hacked", "incident", "phishing attack", "phishing campaign", "phishing", "ddos", "denial of service", "attack", "threat actor", "security flaw", "security issue", "malware analysis", "threat intelligence", "forensics", "security", "cybersecurity", "infosec", "threat", "risk", "patch", "update", "advisory"]),
]
ACTION_VERBS = ["discovered", "found", "detected", "exploited", "breached", "compromised", "patched", "fixed", "mitigated", "disclosed", "reported", "identified"]
ACTION_SCORE = 15
TECHNICAL = [(r"CVE-\d{4}-\d{4,}", 25), (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 15), (r"\b[a-fA-F0-9]{32}\b", 20), (r"\b[a-fA-F0-9]{64}\b", 20)]
MANY_KEYWORDS, MANY_FACTOR, TITLE_PENALTY = 3, 1.5, 1.5
# (score, title counts more, terms)
NEGATIVE = [
    (40, True, ["prime day", "black friday", "cyber monday", "flash sale", "limited time offer", "clearance"]),
    (25, False, ["deal", "discount", "sale", "offer", "promo", "coupon", "% off", "percent off"]),
    (10, False, ["price", "cost", "buy", "shop", "purchase", "order"]),
    (30, True, ["robot vacuum", "vacuum cleaner", "kitchen appliance", "home appliance", "smart home device", "gaming console", "headphones", "earbuds", "roomba", "air fryer", "instant pot", "sous vide", "coffee maker", "blender"]),
    (20, False, ["vacuum", "kitchen", "appliance", "gadget", "device", "smart speaker", "smart tv", "laptop", "smartphone", "tablet", "wearable", "fitness tracker", "smart watch", "echo", "alexa", "google home"]),
    (35, True, ["buying guide", "top 10", "best of", "product review", "unboxing", "hands on", "first impressions", "versus", "comparison", "roundup", "recommendations"]),
]
MISLEADING = (25, ["security camera", "security system", "home security", "security features", "security device", "smart lock", "doorbell camera", "surveillance camera"])
MISLEADING_GUARD = ["vulnerability", "exploit", "breach", "hack", "attack"]
UNLESS_SCORE = 20
UNLESS = [
    ("hardware question", ["vulnerability", "exploit", "security"]),
    ("bgp", ["hijack", "attack", "security", "vulnerability"]),
    ("peering", ["attack", "security", "breach"]),
    ("transit", ["attack", "security", "breach"]),
    ("ix ", ["attack", "security", "breach"]),
    ("internet exchange", ["attack", "security", "breach"]),
    ("asn", ["hijack", "attack", "security"]),
    ("route", ["hijack", "attack", "security", "poisoning"]),
    ("failover", ["attack", "security", "vulnerability"]),
    ("load balancer", ["vulnerability", "exploit", "security"]),
    ("bandwidth", ["ddos", "attack", "security"]),
    ("new feature", ["security", "vulnerability", "protection"]),
    ("product launch", ["security", "protection", "defense"]),
    ("now available", ["security update", "patch", "fix"]),
    ("announces", ["breach", "vulnerability", "attack", "security"]),
    ("ai features", ["security", "attack", "vulnerability", "malicious"]),
    ("chromebook", ["vulnerability", "exploit", "security", "malware"]),
    ("laptop", ["stolen", "breach", "malware", "security"]),
    ("funding", ["cybersecurity", "security", "breach"]),
    ("acquisition", ["security", "breach", "attack"]),
    ("ipo", ["security", "breach", "attack"]),
    ("earnings", ["breach", "attack", "ransomware"]),
]
THRESHOLDS = {"cybersecurity": 30, "general_news": 70}
DEFAULT_THRESHOLD = 25
EXCLUDED_DOMAINS = ["reddit.com", "twitter.com", "x.com", "facebook.com", "linkedin.com", "youtube.com", "instagram.com", "tiktok.com"]
TITLE_PATTERNS = [
    r"^re: .*question$", r"^re: hardware", r"^re: network", r"^re: bgp", r"^re: dns", r"^job posting", r"^hiring", r"^\[ot\]", r"^\[off.?topic\]",
    r"webinar", r"live webinar", r"upcoming webinar", r"join.*webinar", r"register.*webinar", r"^enisa:", r"^enisa launches", r"^enisa publishes",
]

# Text cleaning.
NAVIGATION = [
    r"\b(Home|About|Contact|Menu|Navigation|Search)\b", r"\b(Subscribe|Newsletter|Sign up|Email updates?)\b", r"\b(Share|Tweet|Facebook|LinkedIn|Pinterest|Reddit)\b",
    r"\b(Previous|Next|Continue reading|Read more)\b", r"\b(Page \d+ of \d+|Pages?:?\s*\d+)\b", r"\b(Comments?|Leave a comment|Reply|Discuss)\b",
    r"\b(Advertisement|Sponsored|Promoted)\b", r"\b(Cookie policy|Privacy policy|Terms of service)\b", r"\b(Follow us|Connect with us|Join us)\b",
]
NAVIGATION_WORDS = ["Home", "About", "Contact", "Menu", "Search", "Share", "Tweet", "Facebook", "LinkedIn", "Email", "Subscribe"]
FOOTERS = [
    r"The post .+ appeared first on .+", r"Source:?\s*https?://\S+", r"Originally published at .+", r"Copyright ©?\s*\d{4}", r"All rights reserved",
    r"Read the full article at .+", r"©\s*\d{4}\s*.+", r"Filed under:?\s*.+", r"Tagged with:?\s*.+", r"\d+ minute read", r"Reading time:?\s*\d+\s*min",
]
MAX_CONTENT, MIN_CONTENT = 10_000, 100
TITLE_SUFFIXES = [
    r"\s*\|\s*SecurityWeek\.Com$", r"\s*\|\s*BleepingComputer$", r"\s*\|\s*The Hacker News$", r"\s*\|\s*Dark Reading$", r"\s*\|\s*ZDNet$",
    r"\s*\|\s*Threatpost$", r"\s*\|\s*CyberScoop$", r"\s*\|\s*Krebs on Security$", r"\s*\|\s*Ars Technica$", r"\s*\|\s*The Register$",
    r"\s*\|\s*Wired$", r"\s*\|\s*TechCrunch$", r"\s*-\s*SecurityWeek\.Com$", r"\s*-\s*BleepingComputer$", r"\s*–\s*[A-Za-z\s]+\s*\|\s*WIRED$",
]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
CONTENT_SELECTORS = [
    "article", '[role="main"]', ".article-content", ".post-content", ".entry-content", ".content-body", ".story-body", ".article-body", ".post-body",
    "main", ".main-content", "#content", ".content", '[itemprop="articleBody"]', ".post", ".entry", ".single-post",
]
DROPPED_ELEMENTS = ["script", "style", "nav", "header", "footer"]
DROPPED_CLASSES = ["advertisement", "ads", "social-share", "comments", "related-articles", "sidebar", "newsletter-signup", "popup", "modal"]
IMAGE_BLOCKED_HOSTS = ["doubleclick", "googleadservices", "amazon-adsystem"]
IMAGE_BLOCKED_PARTS = ["1x1", "2x2", "pixel", "spacer", "icon", "logo", "avatar", "profile", "author", "button", "badge", "tracking", "analytics", "thumbnail", "social", "sidebar", "widget", "advertisement", "sponsor"]

# Entity patterns (name, pattern, category, confidence).
PATTERNS = [
    ("cve", r"(?i)CVE-\d{4}-\d{4,}", "cve", 0.95),
    ("file_hash_md5", r"[a-fA-F0-9]{32}", "file_hash", 0.9),
    ("file_hash_sha1", r"[a-fA-F0-9]{40}", "file_hash", 0.9),
    ("file_hash_sha256", r"[a-fA-F0-9]{64}", "file_hash", 0.9),
    ("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "ip_address", 0.85),
    ("domain", r"[a-zA-Z0-9][a-zA-Z0-9-]{0,61}[a-zA-Z0-9]?\.[a-zA-Z]{2,}", "domain", 0.8),
    ("bitcoin_address", r"(?i)\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", "cryptocurrency", 0.9),
    ("ethereum_address", r"(?i)\b0x[a-fA-F0-9]{40}\b", "cryptocurrency", 0.9),
    ("windows_file_path", r'[A-Za-z]:\\(?:[^<>:"|?*\n\r]+\\)*[^<>:"|?*\n\r]+', "file_path", 0.75),
    ("unix_file_path", r"\/(?:[^\/\x00]+\/)*[^\/\x00]+", "file_path", 0.75),
    ("registry_key", r"(?i)HK(?:EY_)?(?:LOCAL_MACHINE|CURRENT_USER|CLASSES_ROOT|USERS|CURRENT_CONFIG)(?:\\[^\\\s\n\r]+)+", "registry_key", 0.85),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "email", 0.85),
]
KNOWN_DOMAINS = [
    "example.com", "test.com", "localhost", "domain.com", "google.com", "microsoft.com", "apple.com", "amazon.com", "github.com", "stackoverflow.com",
    "facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com", "reddit.com", "cloudflare.com", "akamai.com",
    "fastly.com", "amazonaws.com", "gmail.com", "outlook.com", "yahoo.com", "hotmail.com", "wikipedia.org", "wordpress.com", "adobe.com", "oracle.com",
]
KNOWN_MAILS = ["user@example.com", "test@test.com", "admin@domain.com"]
KNOWN_IPS = ["0.0.0.0", "127.0.0.1", "255.255.255.255", "1.1.1.1"]
ENTITY_NETWORKS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "127.0.0.0/8", "224.0.0.0/4", "240.0.0.0/4"]
IOC_NETWORKS = [*ENTITY_NETWORKS, "255.255.255.255/32", "0.0.0.0/8"]
HIVES = ["HKEY_LOCAL_MACHINE", "HKEY_CURRENT_USER", "HKEY_CLASSES_ROOT", "HKEY_USERS", "HKEY_CURRENT_CONFIG", "HKLM", "HKCU", "HKCR"]
CODE_SPANS = [r"```[\s\S]*?```", r"<code>[\s\S]*?</code>", r"<pre>[\s\S]*?</pre>", r"example:[\s\S]*?\n\n", r"demo:[\s\S]*?\n\n"]
NEW_WEIGHTS = {"cve": 80, "file_hash": 60, "ip_address": 55, "domain": 50}
DEFAULT_WEIGHT = 50
IOC_DOMAINS = ["localhost", "local", "internal", "test", "example.com", "example.org", "example.net", "invalid", "localhost.localdomain", "broadcasthost", "ip6-localhost", "ip6-loopback"]
IOC_TLDS = ["local", "localhost", "home", "corp", "lan", "internal"]
INTEL_TYPES = {
    "ip_address": ["Intel::ADDR", "Intel::SUBNET"],
    "domain": ["Intel::DOMAIN", "Intel::URL", "Intel::EMAIL"],
    "file_hash": ["Intel::FILE_HASH", "Intel::MD5", "Intel::SHA1", "Intel::SHA256"],
}
