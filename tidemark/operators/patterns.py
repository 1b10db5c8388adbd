"""Term lists and patterns of the line, page and rule operators, all for lower-cased text.

Engines differ in whether \\b takes accented letters for parts of a word; `bounded` spells it out.
"""


def bounded(pattern: str) -> str:
    """The pattern with each \\b as a bound of ASCII or Latin-1 words, in terms that all engines share."""
    return pattern.replace(r"\b", "(?:^|$|[^a-z0-9_à-öø-ÿ])")


# Patterns that a line needs one of, by class.
HOOKS = {
    "question": r"(\?|^\s*(how|why|what|who|when|did|does|do|is|are|which)\b)",
    "stakes": r"(\$\s*\d|\b(on the line|for the (win|title|lead)|to win|everything|last (place|second|lap)|final (lap|round|race)|match point|sudden death|winner takes)\b)",
    "disbelief": r"\b(no way|no shot|nah|cant believe|can'?t believe|cant be real|can'?t be real|not real|how is this real|unreal|i'?m done|im done)\b",
    "controversy": r"\b(shouldn'?t|should not|didn'?t count|doesn'?t count|robbed|rigged|cheated|illegal|not fair|how is this allowed|this ain'?t it)\b",
    "direct": r"\b(wait for|wait till|watch(?: till| until)?|keep watching|you (have|need) to see|tell me why|pov|the way|watch this|look what)\b",
}
DESCRIPTIVE = r"\b(we (just|made)|here (is|are)|this is (a|the)|reacts?|reaction|highlights?|clip of|footage|compilation|moment where|when (he|she|they) said)\b"
GIVEAWAY = r"\b(he|she|they|it|the \w+)\s+(won|lost|crashed|died|scored|beat|smashed|flipped|finished|ended|fell|missed|nailed|dropped|broke)\b"
BAIT = (
    r"((^|\b)(just\s+)?(said|says|say|did|does|do|goes)\s+what\b[\s\W]*$)|\b(you'?ll never guess|you wo?n'?t believe|wo?n'?t believe (this|that|what|it|how|why)|will (shock|surprise|blow) (you|your mind|the world)"
    r"|what happens? next|the reason (why|is why)|wait ?(til+|till) you (see|hear) what|number \w+ will (shock|surprise))\b"
)
FILLER = (
    r"^\W*(?:what(?:'?s| is)?\s+(?:happening|going\s+on|even\s+(?:happening|going\s+on))|this\s+is\s+(?:crazy|wild|insane|nuts|mad|unreal|actually\s+crazy|so\s+(?:crazy|wild|insane))|(?:nah\s+)?this\s+is\s+(?:so\s+)?(?:crazy|wild|insane|unserious|diabolical)"
    r"|nah\s+this\s+is\s+(?:wild|crazy|actually\s+crazy|insane|nuts|unreal)|(?:nah\s+)?(?:this|that)\s+can'?t\s+be\s+real|no\s+way|no\s+shot|so\s+(?:crazy|wild|unserious)|peak\s+chaos|this\s+is\s+peak\s+\w+"
    r"|why\s+(?:did|does|is)\s+this\s+(?:even\s+)?(?:happen|happening|real|so\s+\w+)|how\s+is\s+this\s+(?:even\s+)?real|you\s+(?:have|need)\s+to\s+see\s+this|wait\s+for\s+(?:it|the\s+end)|tell\s+me\s+why\s+this\s+happened"
    r"|the\s+way\s+this\s+ends(?:\s+is\s+\w+)?|watch\s+(?:this|till\s+the\s+(?:very\s+)?end))\W*$"
)
EMOJI = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"

# What stands between a visitor and a page's files, in order of priority.
BARRIERS = [
    ("login", [r"\blog[\s-]?in\b", r"\bsign[\s-]?in\b", r"\bsignin\b", r"login required", r"please log in", r"enter your password", r"members?[- ]only", r"authenticate to"]),
    ("signup", [r"\bsign[\s-]?up\b", r"\bsignup\b", r"create (an? )?account", r"create your account", r"register (now|to|for)", r"\bjoin (now|free|today)\b", r"become a member"]),
    ("payment", [r"\bpaywall\b", r"\bsubscribe\b", r"subscription required", r"\bpricing\b", r"upgrade to (unlock|access|view|watch)", r"buy now", r"add to cart", r"\bcheckout\b", r"\bpurchase\b", r"unlock (with|for) \$?\d", r"start (your )?(free )?trial"]),
    ("manual", [r"request access", r"email (us|me) (to|for)", r"\bdm (me|us)\b", r"apply (now|here|to)", r"fill out (the|this) form", r"contact (us|me) to"]),
]

# Sections of a campaign's rules by the words of their lines; marks of banned terms and of disclosure.
SECTIONS = {
    "platform_rules": ["tiktok", "reels", "shorts", "instagram", "youtube", "aspect", "vertical", "9:16", "length", "seconds", "duration"],
    "submission_process": ["submit", "submission", "whop", "post link", "link in", "how to enter"],
    "deadlines": ["deadline", "due date", "ends on", "closes", "expires"],
    "payout_terms": ["$", "per 1", "cpm", "budget", "payout", "rate", "rpm"],
}
BANNED_MARKS = ["banned", "prohibited", "do not use", "don't use", "no mention of", "avoid", "not allowed", "forbidden", "blocklist", "blacklist"]
DISCLOSURE_MARKS = ["disclosure", "#ad", "ftc", "sponsored", "paid partnership"]

HOOKS = {name: bounded(p) for name, p in HOOKS.items()}
DESCRIPTIVE, GIVEAWAY, BAIT, FILLER = map(bounded, (DESCRIPTIVE, GIVEAWAY, BAIT, FILLER))
BARRIERS = [(name, [bounded(p) for p in own]) for name, own in BARRIERS]

# Punctuation and its form in ASCII, and a word with the separators after it.
PUNCTUATION = [(" *[‒–—―−﹘] *", " - "), ("[‐‑⁃﹣－]", "-"), ("[‘’ʼ′‵]", "'"), ("[“”″‶]", '"')]
TITLE_WORD = "[^ /-]+[ /-]*|[ /-]+"

# White space, as it is trimmed.
BLANK = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# What error texts hold, in lower case.
RATE_MARKS = ["429", "rate limit", "rate_limit", "tpm", "tpd", "rpm", "rpd", "quota", "resource_exhausted", "resourceexhausted", "insufficient_quota"]
DAY_MARKS = ["per day", "perday", "per_day", "tpd", "rpd", "daily", "requests per day", "tokens per day"]
MINUTE_MARKS = ["per minute", "perminute", "per_minute", "tpm", "rpm"]
GONE_MARKS = ["not found", "does not exist", "is not supported", "not available", "deprecated", "has been removed", "no longer available"]
SHARE_DENIED = ["change the permission", "anyone with the link", "not have access", "access denied", "no longer available", "permission denied"]
SHARE_BUSY = ["have had many accesses", "many accesses", "too many users", "too many requests", "rate limit", "quota exceeded", "try again later"]
BLOCK_MARKS = [
    "http error 403", "403: forbidden", "403 forbidden", "error 403", "forbidden", "sign in to confirm you're not a bot", "confirm you're not a bot", "not a bot", "verify you're human", "unusual traffic",
    "this content isn't available", "http error 429", "429: too many requests", "too many requests", "429 too many", "failed to extract any player response", "please sign in",
]
BUSY_MARKS = [
    "sign in to confirm you're not a bot", "confirm you're not a bot", "not a bot", "http error 429", "429: too many requests", "too many requests", "429 too many", "temporarily blocked", "rate-limited", "rate limited",
    "verify you're human", "unusual traffic", "this content isn't available", "drive folder throttled", "throttled (temporary)", "retryable on a later run", "have had many accesses", "many accesses", "quota exceeded",
    "try again later", "throttl",
]
# Labels of a failed run by what its reason holds, in order.
REASON_TAGS = [
    (BUSY_MARKS, "retryable throttle"), (["language"], "language gate"), (["dead-floor", "dead floor"], "dead floor"), (["zero usable", "no usable"], "no usable sources"), (["no footage"], "no footage"),
    (["no candidate moments", "no moments"], "no moments"),
]
# Hosts, extensions and words by which links are told apart.
VIDEO_HOSTS = ["youtube.com", "youtu.be", "kick.com", "twitch.tv", "vimeo.com"]
CHANNEL_HOSTS = ["youtube.com", "youtu.be"]
ONE_VIDEO = ["watch?v=", "youtu.be/", "/shorts/", "/live/", "/embed/"]
CHANNEL_PATHS = ["/@", "/channel/", "/user/", "/c/", "list="]
CHANNEL_ENDS = r"(/videos|/streams|/featured|youtube\.com)/*$"
KINDS = {"footage": "mp4 mov mkv webm m4v avi ts flv", "asset": "png jpg jpeg webp gif", "doc": "pdf docx doc txt md markdown rtf csv tsv xlsx xls gdoc gsheet gslides json"}
DOC_ENDS = r"\.(" + KINDS["doc"].replace(" ", "|") + ")$"
FILE_ENDS = r"\.(" + " ".join(KINDS.values()).replace(" ", "|") + ")$"
RULE_LABELS = [
    "rule", "requirement", "guideline", "content document", "content doc", "brief", "sop", "instruction", "clipping", "how to", "campaign doc", "notion", "must read", "readme", "read me", "policy", "criteria", "faq",
]
RULE_PATHS = ["rule", "requirement", "guideline", "brief", "/sop", "instruction", "policy", "criteria", "content-doc"]
# What leads to rules elsewhere, and prefaces of a list of lines.
POINTER = bounded(
    r"\bsee\b[^.\n]{0,40}\b(rules?|requirements?|documents?|docs?|resources?|below|guidelines?)\b|in (the )?resources?\b|linked (doc|document|below)|content document|refer to (the )?(doc|link)"
    r"|\battached\b|below in resources|see (the )?(doc|document|link|google doc)"
)
PREFACES = ["here are", "here's", "sure", "captions:", "caption:"]
# Emoji that a title is cut of at its end, and captions made around one word.
CLOSING = "😭✌️🔥💀🙏✋"
NOUN_TEMPLATES = ["wait till you hear about {} 👀", "the truth about {} 😳", "nobody talks about {} enough 😭", "what they said about {} 💀"]
