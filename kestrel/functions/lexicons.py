"""Word lists and character maps.

FIXED VALUES — these must equal the moderation pipeline we rebuild for its features and
decisions to come out the same.  They are stated plainly and in their original order.
Every operator takes its list as an argument; these are only the defaults.
"""

# FIXED VALUES: message-level features (training build and serving).
BAD_WORDS = ["trash", "kill", "die", "ugly", "stupid", "idiot", "hate", "loser", "dumb"]
PERSONAL_PRONOUNS = ["you", "your", "you're", "ur", "u"]

# FIXED VALUES: alternate feature set used by the labelling tool.
ALT_PRONOUNS = ["i", "me", "my", "mine", "you", "your", "yours"]
KEYWORD_CATEGORIES = {
    "slurs": ["trash", "scum", "garbage", "loser", "idiot", "stupid", "dumb"],
    "threats": ["kill", "die", "hurt", "attack", "destroy"],
    "harassment": ["ugly", "fat", "worthless", "pathetic", "waste"],
}
PUNCTUATION_CHARS = "!?.,;:"
EMOJI_MIN_CODEPOINT = 127001  # code points strictly above 127000

# FIXED VALUES: drift monitoring trigger words.
TRIGGER_WORDS = ["kill", "die", "hurt", "trash", "ugly", "stupid",
                 "hate", "loser", "idiot", "dumb", "waste"]

# FIXED VALUES: evasion cleaner character map, in the original order.
LEET_MAP = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s",
            "@": "a", "$": "s", "!": "i", "7": "t", "8": "b"}

# Python's str.split() whitespace (str.isspace code points), written as one regex class that
# Java and RE2 both accept.  Not a list from the pipeline: it pins Python's tokenizer.
WS_CLASS = (r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")

# The same set for Java regular expressions: Unicode White_Space plus the four separators
# \x1C-\x1F that Python also splits on.  One property test per character instead of fifteen
# ranges (about 2.5x faster on long texts).  RE2 lacks the property, so SQL uses WS_CLASS.
WS_CLASS_JAVA = r"\p{IsWhite_Space}\x{1C}-\x{1F}"

# The same set as characters, and its ASCII part as a class that Java tests with one table look-up.
WS_CHARS = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())
WS_CLASS_ASCII = r"\x{09}-\x{0D}\x{1C}-\x{20}"

# Hard terms are loaded from a data file (one per line) rather than spelt out in code.
HARD_TERMS_FILE = "hard_terms.txt"


def load_hard_terms(path: str | None = None) -> list[str]:
    import os
    if path is None:
        path = os.path.join(os.path.dirname(__file__), HARD_TERMS_FILE)
    with open(path, encoding="utf-8") as fh:
        return [ln.strip() for ln in fh if ln.strip() and not ln.startswith("#")]
