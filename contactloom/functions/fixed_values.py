"""Lists that must hold exactly these entries for results to be right."""

# --- fixed values: phone patterns, in priority order (ordinal 1 first) ------------------------
PHONE_PATTERNS = [
    r"\(\d{3}\)\s?\d{3}[-\s]?\d{4}",
    r"\d{3}[\s-]\d{3}[-\s]\d{4}",
    r"\(\d{3}\)\d{3}[-\s]?\d{4}",
    r"\(\d{3}\)[-\s]?\d{3}[-\s]?\d{4}",
    r"\d{3}[.]\d{3}[.]\d{4}",
    r"\d{3}-\d{3}-\d{4}",
    r"\+\d{1}[\s]?\d{10}",
    r"\+\d{1}[\s]?\d{3}[.]\d{3}[.]\d{4}",
    r"\+\d{1}[\s]?\d{3}[-]\d{3}[-]\d{4}",
    r"1-\d{3}-\d{3}-\d{4}",
    r"\d{10}",
    r"1\s?\d{10}",
    r"1\s?\d{3}[.]\d{3}[.]\d{4}",
    r"1\s?\d{3}[-]\d{3}[-]\d{4}",
    r"1\(\d{3}\)\d{7}",
    r"1\(\d{3}\)[-]\d{3}[-]\d{4}",
    r"\+\d{1}[\s]?\d{3}[-\s]\d{3}[-\s]\d{4}",
    r"\+\d{1}[\s]?\d{3}[-]\d{3}[-][A-Z]{4}",
    r"\d{3}[-]\d{3}[-][A-Z]{4}",
    r"\d{3}[.]\d{3}[.][A-Z]{4}",
    r"\(\d{3}\)[-]\d{3}[-][A-Z]{4}",
    r"\(\d{3}\)\d{3}[-][A-Z]{4}",
    r"\d{3}\s\d{3}\s[A-Z]{3}",
    r"\d{3}\s\d{3}[-][A-Z]{4}",
    r"\(\d{3}\)\s\d{3}[-][A-Z]{4}",
    r"1-\d{3}-\d{3}-[A-Z]{4}",
    r"1\s\d{3}[.]\d{3}[.][A-Z]{4}",
    r"1\s\d{3}[-]\d{3}[-][A-Z]{4}",
]

# --- fixed values: url suffixes of files that are not pages -----------------------------------
UNWANTED_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg",
    ".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv",
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".pdf",
    ".zip", ".rar", ".tar", ".gz", ".7z",
    ".js", ".css",
]

# --- fixed values: words that make a link worth following -------------------------------------
LINK_KEYWORDS = [
    "contact", "about", "service", "call", "support", "help",
    "location", "legal", "blog", "store", "quote",
]

# --- fixed values: social sites that are never followed ---------------------------------------
SOCIAL_DOMAINS = ["facebook.com", "twitter.com", "instagram.com", "youtube.com"]

# --- fixed values: tags that open a text block, and tags that only separate blocks -------------
BLOCK_TAGS = [
    "p", "div", "li", "footer", "section", "header", "aside", "blockquote",
    "address", "nav", "article", "h1", "h2", "h3", "h4", "h5", "h6",
]
SEPARATOR_TAGS = ["ul", "ol", "table", "tr", "td", "br"]

# --- fixed values: named entities that can occur in or beside a number or a tel: link ----------------
NAMED_ENTITIES = {
    "&nbsp;": " ", "&lpar;": "(", "&rpar;": ")", "&plus;": "+", "&period;": ".",
    "&ensp;": "\u2002", "&emsp;": "\u2003", "&thinsp;": "\u2009", "&numsp;": "\u2007",
    "&ndash;": "\u2013", "&mdash;": "\u2014", "&hyphen;": "\u2010", "&dash;": "\u2010", "&num;": "#",
    "&copy;": "\u00a9", "&reg;": "\u00ae", "&middot;": "\u00b7", "&bull;": "\u2022",
    "&colon;": ":", "&sol;": "/", "&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">",
}

# --- fixed values: columns of the exported table -----------------------------------------------
EXPORT_COLUMNS = [
    "Sl", "Website", "Phone Number 1", "Country 1", "Phone Number 2", "Country 2",
    "Phone Number 3", "Country 3",
]
