"""Page types, their patterns and weights, platforms, technologies, roles, labels.

These tables decide results and are therefore stated as they are, in order. Order matters:
ties go to the earlier type, and the first matching role wins.
"""

PAGE_TYPES = ["about", "team", "product", "service", "contact", "careers", "pricing", "blog", "news", "other"]

# First match on the lower-cased path, not anchored at its start.
PATH_PATTERNS = {
    "about": [r"/about[-_]?us", r"/about/?$", r"/company/?$", r"/who[-_]?we[-_]?are", r"/our[-_]?story"],
    "team": [r"/team/?", r"/people/?", r"/leadership/?", r"/management/?", r"/our[-_]?team/?", r"/founders/?",
             r"/executives/?"],
    "product": [r"/products?/?", r"/solutions?/?", r"/platform/?", r"/features?/?", r"/offerings?/?"],
    "service": [r"/services?/?", r"/what[-_]?we[-_]?do/?", r"/capabilities/?", r"/consulting/?"],
    "contact": [r"/contact[-_]?us/?", r"/contact/?$", r"/get[-_]?in[-_]?touch/?", r"/reach[-_]?us/?",
                r"/locations?/?"],
    "careers": [r"/careers?/?", r"/jobs?/?", r"/join[-_]?us/?", r"/hiring/?", r"/opportunities/?",
                r"/work[-_]?with[-_]?us/?"],
    "pricing": [r"/pricing/?", r"/plans?/?", r"/packages?/?", r"/cost/?"],
    "blog": [r"/blog/?", r"/articles?/?", r"/insights?/?", r"/resources?/?"],
    "news": [r"/news/?", r"/press/?", r"/media/?", r"/announcements?/?"],
}

# Weighted path patterns.
URL_WEIGHTS = {
    "about": [(r"/about[-_]?us/?$", 1.0), (r"/about/?$", 1.0), (r"/company/?$", 0.9),
              (r"/who[-_]?we[-_]?are/?$", 0.9), (r"/our[-_]?story/?$", 0.9), (r"/mission/?$", 0.8),
              (r"/vision/?$", 0.8), (r"/values/?$", 0.8), (r"/history/?$", 0.8)],
    "team": [(r"/team/?$", 1.0), (r"/our[-_]?team/?$", 1.0), (r"/people/?$", 0.9), (r"/leadership/?$", 0.9),
             (r"/management/?$", 0.9), (r"/founders/?$", 0.9), (r"/executives/?$", 0.9), (r"/board/?$", 0.8),
             (r"/advisors/?$", 0.8), (r"/team/", 0.7)],
    "product": [(r"/products?/?$", 1.0), (r"/solutions?/?$", 0.9), (r"/platform/?$", 0.9), (r"/features?/?$", 0.9),
                (r"/offerings?/?$", 0.9), (r"/tools?/?$", 0.8), (r"/software/?$", 0.8), (r"/products?/", 0.7)],
    "service": [(r"/services?/?$", 1.0), (r"/what[-_]?we[-_]?do/?$", 0.9), (r"/capabilities/?$", 0.9),
                (r"/consulting/?$", 0.9), (r"/expertise/?$", 0.8), (r"/services?/", 0.7)],
    "contact": [(r"/contact[-_]?us/?$", 1.0), (r"/contact/?$", 1.0), (r"/get[-_]?in[-_]?touch/?$", 0.9),
                (r"/reach[-_]?us/?$", 0.9), (r"/locations?/?$", 0.8), (r"/offices?/?$", 0.8), (r"/support/?$", 0.7)],
    "careers": [(r"/careers?/?$", 1.0), (r"/jobs?/?$", 1.0), (r"/join[-_]?us/?$", 0.9), (r"/hiring/?$", 0.9),
                (r"/opportunities?/?$", 0.9), (r"/work[-_]?with[-_]?us/?$", 0.9), (r"/openings?/?$", 0.8),
                (r"/careers?/", 0.7)],
    "pricing": [(r"/pricing/?$", 1.0), (r"/plans?/?$", 0.9), (r"/packages?/?$", 0.9), (r"/cost/?$", 0.8),
                (r"/subscription/?$", 0.8)],
    "blog": [(r"/blog/?$", 1.0), (r"/articles?/?$", 0.9), (r"/insights?/?$", 0.9), (r"/resources?/?$", 0.8),
             (r"/learn/?$", 0.8), (r"/blog/", 0.7)],
    "news": [(r"/news/?$", 1.0), (r"/press/?$", 1.0), (r"/press[-_]?releases?/?$", 1.0), (r"/media/?$", 0.9),
             (r"/announcements?/?$", 0.9), (r"/newsroom/?$", 0.9), (r"/news/", 0.7)],
}

# Weighted text patterns.
CONTENT_WEIGHTS = {
    "about": [(r"\bour\s+mission\b", 0.8), (r"\bour\s+vision\b", 0.8), (r"\bfounded\s+in\b", 0.7),
              (r"\bwho\s+we\s+are\b", 0.8), (r"\bour\s+story\b", 0.8), (r"\bcompany\s+overview\b", 0.8)],
    "team": [(r"\bour\s+team\b", 0.8), (r"\bleadership\s+team\b", 0.9), (r"\bexecutive\s+team\b", 0.9),
             (r"\bfounder[s]?\s+&?\s*ceo\b", 0.8), (r"\bboard\s+of\s+directors\b", 0.8)],
    "product": [(r"\bour\s+products?\b", 0.8), (r"\bkey\s+features?\b", 0.7), (r"\bproduct\s+overview\b", 0.8)],
    "service": [(r"\bour\s+services?\b", 0.8), (r"\bwhat\s+we\s+offer\b", 0.7)],
    "contact": [(r"\bcontact\s+us\b", 0.9), (r"\bget\s+in\s+touch\b", 0.9), (r"\bsend\s+us\s+a\s+message\b", 0.8),
                (r"\brequest\s+a\s+demo\b", 0.7)],
    "careers": [(r"\bjob\s+openings?\b", 0.9), (r"\bopen\s+positions?\b", 0.9), (r"\bwe'?re\s+hiring\b", 0.9),
                (r"\bjoin\s+our\s+team\b", 0.9), (r"\bcareer\s+opportunities\b", 0.9)],
    "pricing": [(r"\bpricing\s+plans?\b", 0.9), (r"\bmonthly\s+plan\b", 0.8), (r"\bannual\s+plan\b", 0.8),
                (r"\bfree\s+trial\b", 0.7), (r"\bper\s+month\b", 0.6)],
    "blog": [(r"\blatest\s+posts?\b", 0.8), (r"\bblog\s+posts?\b", 0.9), (r"\bpublished\s+on\b", 0.6)],
    "news": [(r"\bpress\s+release\b", 0.9), (r"\bnews\s+&\s+events?\b", 0.8), (r"\bin\s+the\s+news\b", 0.8)],
}

# Social platforms: hosts, handle patterns tried in order, words that are no handle.
PLATFORM_HOSTS = {
    "linkedin": ["linkedin.com", "www.linkedin.com"],
    "twitter": ["twitter.com", "www.twitter.com", "x.com", "www.x.com"],
    "facebook": ["facebook.com", "www.facebook.com", "fb.com", "www.fb.com"],
    "instagram": ["instagram.com", "www.instagram.com"],
    "youtube": ["youtube.com", "www.youtube.com"],
    "github": ["github.com", "www.github.com"],
}
PLATFORM_HANDLES = {
    "linkedin": [r"linkedin\.com/company/([a-zA-Z0-9_-]+)", r"linkedin\.com/in/([a-zA-Z0-9_-]+)",
                 r"linkedin\.com/showcase/([a-zA-Z0-9_-]+)"],
    "twitter": [r"(?:twitter|x)\.com/([a-zA-Z0-9_]+)(?:/|$|\?)"],
    "facebook": [r"facebook\.com/([a-zA-Z0-9.]+)(?:/|$|\?)", r"fb\.com/([a-zA-Z0-9.]+)(?:/|$|\?)"],
    "instagram": [r"instagram\.com/([a-zA-Z0-9._]+)(?:/|$|\?)"],
    "youtube": [r"youtube\.com/(?:c/|channel/|user/|@)([a-zA-Z0-9_-]+)"],
    "github": [r"github\.com/([a-zA-Z0-9_-]+)(?:/|$|\?)"],
}
PLATFORM_LINK_TYPE = {"twitter": "company", "facebook": "page", "instagram": "company", "youtube": "channel",
                      "github": "organization"}
GENERIC_HANDLES = [
    "share", "sharer", "intent", "login", "signup", "help", "settings", "about", "privacy", "terms", "policy",
    "legal", "support", "contact", "home", "search", "explore", "feed", "notifications", "messages",
]
COMPANY_LINK_TYPES = ["company", "page", "organization", "channel"]

# Patterns of structured data in text. All but the second address pattern ignore case.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
EMAIL_HIDDEN = (
    r"([a-zA-Z0-9._%+-]+)\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|(?:\s+at\s+)|@)\s*([a-zA-Z0-9.-]+)\s*"
    r"(?:\[\s*dot\s*\]|\(\s*dot\s*\)|(?:\s+dot\s+)|\.)\s*([a-zA-Z]{2,})"
)
PLACEHOLDER_DOMAINS = [
    "example.com", "example.org", "example.net", "test.com", "localhost", "domain.com", "email.com",
    "your-email.com", "yourcompany.com",
]
PHONES = [
    r"\+?1?[-.\s]?\(?(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})",
    r"\(?(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})",
    r"(?i)\(?(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})\s*(?:x|ext|extension)?\s*(\d+)?",
    r"(\d{3})[-.\s](\d{3})[-.\s](\d{4})",
]
ADDRESSES = [
    r"(?i)\d+\s+[\w\s]+(?:Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Lane|Ln|Way|Court|Ct|Place|Pl|Circle"
    r"|Cir)\.?(?:\s*,?\s*(?:Suite|Ste|Apt|Unit|#)\s*[\w\d]+)?(?:\s*,?\s*[\w\s]+)?"
    r"(?:\s*,?\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?)?",
    r"[\w\s]+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?",
    r"(?i)[\w\s]+,?\s*[\w\s]+,?\s*[A-Z]{1,2}\d{1,2}\s*\d[A-Z]{2}",
]
SOCIAL_IN_TEXT = {
    "twitter": [r"(?i)(?:https?://)?(?:www\.)?(?:twitter|x)\.com/(@?\w+)", r"@([a-zA-Z_][\w]{0,14})"],
    "linkedin": [r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/(?:in|company)/([^/?]+)"],
    "facebook": [r"(?i)(?:https?://)?(?:www\.)?facebook\.com/([^/?]+)",
                 r"(?i)(?:https?://)?(?:www\.)?fb\.com/([^/?]+)"],
    "instagram": [r"(?i)(?:https?://)?(?:www\.)?instagram\.com/([^/?]+)"],
    "github": [r"(?i)(?:https?://)?(?:www\.)?github\.com/([^/?]+)"],
    "youtube": [r"(?i)(?:https?://)?(?:www\.)?youtube\.com/(?:c/|channel/|user/|@)?([^/?]+)"],
}
SOCIAL_TEXT_SKIP = ["share", "intent", "home", "login", "signup", "about"]

# Technologies by category. All ignore case.
TECHNOLOGIES = {
    "languages": {
        "python": r"\bPython\b", "javascript": r"\b(?:JavaScript|JS)\b", "typescript": r"\b(?:TypeScript|TS)\b",
        "java": r"\bJava\b(?!\s*Script)", "go": r"\b(?:Go|Golang)\b", "rust": r"\bRust\b", "ruby": r"\bRuby\b",
        "php": r"\bPHP\b", "c++": r"\bC\+\+\b", "c#": r"\bC#\b", "swift": r"\bSwift\b", "kotlin": r"\bKotlin\b",
        "scala": r"\bScala\b", "r": r"\bR\b(?:\s+programming)?",
    },
    "frameworks": {
        "react": r"\bReact(?:\.?js)?\b", "angular": r"\bAngular(?:\.?js)?\b", "vue": r"\bVue(?:\.?js)?\b",
        "django": r"\bDjango\b", "flask": r"\bFlask\b", "fastapi": r"\bFastAPI\b",
        "rails": r"\bRuby on Rails\b|\bRails\b", "spring": r"\bSpring\b(?:\s+Boot)?",
        "express": r"\bExpress(?:\.?js)?\b", "nextjs": r"\bNext\.?js\b", "nodejs": r"\bNode\.?js\b",
        ".net": r"\.NET\b", "laravel": r"\bLaravel\b", "svelte": r"\bSvelte\b",
    },
    "databases": {
        "postgresql": r"\b(?:PostgreSQL|Postgres)\b", "mysql": r"\bMySQL\b", "mongodb": r"\bMongoDB?\b",
        "redis": r"\bRedis\b", "elasticsearch": r"\bElasticsearch\b", "dynamodb": r"\bDynamoDB\b",
        "sqlite": r"\bSQLite\b", "cassandra": r"\bCassandra\b", "oracle": r"\bOracle\b(?:\s+Database)?",
        "sql server": r"\bSQL\s+Server\b",
    },
    "infrastructure": {
        "aws": r"\bAWS\b|\bAmazon Web Services\b", "gcp": r"\bGCP\b|\bGoogle Cloud\b", "azure": r"\bAzure\b",
        "kubernetes": r"\bKubernetes\b|\bK8s\b", "docker": r"\bDocker\b", "terraform": r"\bTerraform\b",
        "ansible": r"\bAnsible\b", "jenkins": r"\bJenkins\b", "circleci": r"\bCircleCI\b",
        "github actions": r"\bGitHub Actions\b",
    },
    "tools": {
        "git": r"\bGit\b(?!Hub)", "jira": r"\bJira\b", "slack": r"\bSlack\b", "figma": r"\bFigma\b",
        "kafka": r"\bKafka\b", "rabbitmq": r"\bRabbitMQ\b", "graphql": r"\bGraphQL\b",
        "rest api": r"\bREST(?:ful)?\s+API\b", "nginx": r"\bNginx\b", "apache": r"\bApache\b(?:\s+HTTP)?",
    },
}

# Model labels kept by the pipeline, and by the page-level extractor (which knows no LAW).
LABELS = {
    "PERSON": "person", "ORG": "org", "GPE": "location", "LOC": "location", "PRODUCT": "product", "DATE": "date",
    "TIME": "date", "MONEY": "money", "PERCENT": "money", "NORP": "org", "FAC": "location", "EVENT": "date",
    "WORK_OF_ART": "product", "LAW": "org",
}
PAGE_LABELS = {k: v for k, v in LABELS.items() if k != "LAW"}

ENTITY_TYPES = ["person", "org", "location", "product", "date", "money", "email", "phone", "address",
                "social_handle", "tech_stack"]

# Roles, tried in order, all ignoring case.
ROLES = [
    (r"\b(CEO|Chief Executive Officer)\b", "CEO"), (r"\b(CTO|Chief Technology Officer)\b", "CTO"),
    (r"\b(CFO|Chief Financial Officer)\b", "CFO"), (r"\b(COO|Chief Operating Officer)\b", "COO"),
    (r"\b(CMO|Chief Marketing Officer)\b", "CMO"), (r"\b(CIO|Chief Information Officer)\b", "CIO"),
    (r"\b(CISO|Chief Information Security Officer)\b", "CISO"), (r"\b(CPO|Chief Product Officer)\b", "CPO"),
    (r"\b(CRO|Chief Revenue Officer)\b", "CRO"), (r"\b(CLO|Chief Legal Officer)\b", "CLO"),
    (r"\b(Founder|Co-Founder|Co-founder|Cofounder)\b", "Founder"), (r"\b(President)\b", "President"),
    (r"\b(Chairman|Chair)\b", "Chairman"), (r"\b(VP|Vice President)\s+(of\s+)?(\w+)", "VP"),
    (r"\b(Director)\s+(of\s+)?(\w+)", "Director"), (r"\b(Senior Vice President|SVP)\b", "SVP"),
    (r"\b(Executive Vice President|EVP)\b", "EVP"), (r"\b(Head)\s+(of\s+)?(\w+)", "Head"),
    (r"\b(Manager)\s+(of\s+)?(\w+)", "Manager"), (r"\b(Lead)\s+(\w+)", "Lead"),
    (r"\b(Engineer|Developer|Architect)\b", "Engineer"), (r"\b(Designer)\b", "Designer"),
    (r"\b(Analyst)\b", "Analyst"),
]

# Relationship words, tried in order, as plain substrings of the lower-cased context.
RELATIONSHIPS = [
    ("partner", ["partner", "partnership", "partnered"]),
    ("client", ["client", "customer", "serve", "serving"]),
    ("investor", ["investor", "invested", "funding", "backed by", "funded by"]),
    ("competitor", ["competitor", "competing", "versus", "vs."]),
    ("acquisition", ["acquired", "acquisition", "merger"]),
]

# Legal forms dropped from the end of an organization name, in order.
LEGAL_SUFFIXES = [r"\s+inc\.?$", r"\s+llc\.?$", r"\s+ltd\.?$", r"\s+corp\.?$", r"\s+corporation$", r"\s+company$",
                  r"\s+co\.?$", r"\s+limited$"]

# Report sections: (id, display name, priority). The summary is written last.
SECTIONS = [
    ("company_overview", "Company Overview", 1), ("business_model", "Business Model & Products", 2),
    ("team_leadership", "Team & Leadership", 3), ("market_position", "Market Position", 4),
    ("technology", "Technology & Operations", 5), ("key_insights", "Key Insights", 6),
    ("red_flags", "Red Flags & Concerns", 7), ("executive_summary", "Executive Summary", 0),
]
REQUIRED_SECTIONS = ["company_overview", "business_model", "executive_summary"]
EXPORT_SECTIONS = ["companyOverview", "businessModel", "teamLeadership", "marketPosition", "technology",
                   "keyInsights", "redFlags"]
