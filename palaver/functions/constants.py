"""Values that results depend on, as regular-expression text for Java (Spark)."""

# Invisible marks that exports put around text.
MARKS = "‎‏‪‫‬‭‮⁦⁧⁨⁩﻿"
# White space.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS, NOT_WS = f"[{SPACE}]", f"[^{SPACE}]"
#: A word character, and a word boundary by it; Java's own \b goes by other rules.
WORD = r"[\p{L}\p{N}_]"
BOUND = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
#: Punctuation at a token's edge: category P and the nine ASCII symbols.
EDGE = r"[\p{P}$+<=>^|~`]"
# Quotation marks and what they become.
QUOTES = "‘’‚‛′ʼ“”„‟″"
PLAIN_QUOTES = "''''''" + '"""""'

URL, PHONE = "<URL>", "<PHONE>"
# Short links without a scheme, and top-level domains.
SHORT_LINKS = r"chat\.whatsapp\.com|api\.whatsapp\.com|whatsapp\.com|wa\.me|youtu\.be|bit\.ly|t\.me"
TOP_LEVEL = "com|org|net|edu|gov|in|co|io|app|me|ly|info|biz|us|uk"
# What counts as sensitive in a published term.
SENSITIVE = rf"https?://|www\.|@|chat\.whatsapp|wa\.me|whatsapp\.com|{BOUND}[a-z0-9-]+\.(?:{TOP_LEVEL}){BOUND}"
SENSITIVE_DIGITS = 7

# Verbs of system sentences, and quotation marks in them.
SYSTEM_VERBS = "added|removed|left|joined|created|changed|deleted|turned|updated|pinned|unpinned|invited|reset"
SYSTEM_QUOTES = "“”\"‘’"

# Media placeholders.
MEDIA_KINDS = "image|photo|video|audio|sticker|gif|document|contact card|media|voice message|ptt"
MEDIA_LABELS = {"photo": "image", "ptt": "audio", "voice message": "audio", "contact card": "contact"}

# The English stop words.
STOPWORDS = tuple(
    """
    a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot could couldn't did didn't
    do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him
    himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought
    our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves then there
    there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when
    when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
    """.split()
)

# Letters whose Unicode names begin with LATIN, and with DEVANAGARI.
LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{1D00}-\x{1D25}\x{1D62}-\x{1D65}\x{1D6B}-\x{1D77}\x{1D79}-\x{1D9A}\x{1E00}-\x{1EFF}\x{2090}-\x{209C}\x{2184}\x{2C60}-\x{2C7C}\x{2C7E}-\x{2C7F}\x{A722}-\x{A76F}\x{A771}-\x{A787}\x{A78B}-\x{A7CA}\x{A7D0}-\x{A7D1}\x{A7D3}\x{A7D5}-\x{A7D9}\x{A7F5}-\x{A7F7}\x{A7FA}-\x{A7FF}\x{AB30}-\x{AB5A}\x{AB60}-\x{AB64}\x{AB66}-\x{AB68}\x{FB00}-\x{FB06}\x{1DF00}-\x{1DF1E}\x{1DF25}-\x{1DF2A}"
DEVANAGARI = r"\x{904}-\x{939}\x{93D}\x{950}\x{958}-\x{961}\x{971}-\x{97F}\x{A8F2}-\x{A8F7}\x{A8FB}\x{A8FD}-\x{A8FE}"
DEVANAGARI_BLOCK = r"[\x{900}-\x{97F}]"

TOKEN_SCRIPTS = ("latin", "devanagari", "placeholder", "other")
MESSAGE_CLASSES = ("latin_only", "devanagari_only", "mixed_script", "other_script_only", "no_alphabetic")
SHARE_BANDS = ((0.0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1.0))
SHORT_TOKENS = 3
SYSTEM_CATEGORIES = ("security_code_changed", "member_added", "settings_changed", "other_system_event")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
