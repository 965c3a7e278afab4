"""Regular expressions, written once for Spark (Java regex) and derived for RE2.

Spark evaluates the Java spelling.  The SQL oracle (DuckDB, RE2) gets
``re2(pattern)``.  Rules that keep the two engines equal:

* words are ``[\\p{L}\\p{N}_]`` (``\\w`` is ASCII in Java and RE2),
* whitespace is spelled out as what the reference's ``\\s`` takes (Unicode blanks
  too; Java's and RE2's ``\\s`` are ASCII), digits are ``\\p{Nd}``,
* Java patterns that use ``.`` start with ``(?d)`` so only ``\\n`` ends a line,
  as in RE2; ``re2`` drops the flag,
* case-insensitive Java patterns use ``(?iu)`` (Unicode folding, as RE2 does).
"""

from __future__ import annotations

WORD_CHAR = r"[\p{L}\p{N}_]"
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
DIGIT = r"\p{Nd}"

# ---------------------------------------------------------------------------
# These must equal the reference's patterns for equal results.
# ---------------------------------------------------------------------------

# Log markers.  As written, the Traceback and level alternatives are preceded
# by a newline and eight spaces (a backslash-continued raw string).
LOG_LEVELS = ("INFO|[Ii]nfo|FAIL|[Ff]ail|WARN(ING)?|[Ww]arn(ing)?|FATAL|[Ff]atal|"
              "DEBUG|[Dd]ebug|SYSTEM|[Ss]ystem|ERROR|[Ee]rror")
_LOG_PREFIX = r"\n        "


def log_pattern(as_written: bool = True) -> str:
    prefix = _LOG_PREFIX if as_written else ""
    return ("(?d)"
            rf"{DIGIT}{{4}}-{DIGIT}{{2}}-{DIGIT}{{2}} {DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}\.{DIGIT}{{6}}:"
            rf"|{prefix}[Tt]raceback.{{0,10}}:"
            r"|[Bb]acktrace.{0,10}:"
            r"|[Ll]ogs?:"
            rf"|{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}"
            rf"|{prefix}({LOG_LEVELS}){WS}*:")


LOG = log_pattern(True)
LOG_INTENDED = log_pattern(False)

# A log line outside a fence (used by the "intended" form of remove_log).
def log_line_pattern(as_written: bool = True) -> str:
    return "(?s)(" + log_pattern(as_written)[len("(?d)"):] + ").+?\n"


FENCE = r"(?s)```.+?```"
# The URL pattern's ``\b`` is the Unicode word boundary of Python's ``re`` on
# str, spelled out with lookarounds so the result does not depend on the JVM
# (Java 19+ made a bare ``\b`` ASCII-only).
WORD_BOUNDARY = rf"(?:(?<={WORD_CHAR})(?!{WORD_CHAR})|(?<!{WORD_CHAR})(?={WORD_CHAR}))"
URL = (r"https?:\/\/(www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}" + WORD_BOUNDARY +
       r"([-a-zA-Z0-9()@:%_\+.~#?&//=]*)")
MARKDOWN_EMPHASIS_OR_LINK = r"(?d)(?:__|[*#])|\[(.*?)\]\(.*?\)"
MARKDOWN = (r"(?d)#+|[*]+|[_]+|[>]+|[-][-]+|[+]|[`]+|!\[.+\]\(.+\)|\[.+\]\(.+\)"
            r"|<.{0,6}>|\n|\r|<!---|-->|<>|=+")

# Tokenisers: plain words, and the word-vector tokeniser (contractions,
# hyphenated words, words, punctuation).
WORD = WORD_CHAR + "+"
VECTOR_TOKEN = (rf"{WORD_CHAR}+'{WORD_CHAR}+|{WORD_CHAR}+-{WORD_CHAR}+|{WORD_CHAR}+"
                r"|[(...).,!:" + '"' + r";?]")
# Upper-case letters, and the Roman numerals that count as upper case.
UPPER_INITIAL = r"^[\p{Lu}\x{2160}-\x{216F}]"

# Hand-made feature counters.
USERNAME = rf"(?d){WS}@.+{WS}"
ISSUE_REFERENCE = rf"{WS}#{DIGIT}+{WS}"
LINK = rf"(?d){WS}\[(.*?)\]\((.*?)\){WS}"
IMAGE = rf'(?d){WS}!\[[^\]]*\]\((.*?){WS}*("(?:.*[^"])")?{WS}*\){WS}'
CODE_MARK = r"``|```"
ASTERISK = r"\*"
UNDERSCORE = r"_"
HASH = r"#"

# Keyword classifier word lists, in the reference's class order bug, doc, feature.
BUG_KEYWORDS = ("version|packages|line|file|model|core|import|source|local|device|error|"
                "build|return|unknown|backtrace|debug|bug|panic|test|what")
DOC_KEYWORDS = ("issue|doc|example|version|define|model|guide|use|src|source|need|"
                "description|link|changing|api|")
FEATURE_KEYWORDS = ("feature|version|current|using|model|contrib|operation|type|would|use|"
                    "unsupported|convert|information|system")

# HTML link target and image tag of rendered issue text.
HTML_LINK = r'<a href="(.*?)">(.*?)</a>'
HTML_IMG = r"<img[^>]*>"
HTML_TAG = r"<[^>]+>"
IMAGE_TOKEN = " IMAGE_TOKEN "

# Links of issue text before rendering: fences and code spans are not rendered;
# an inline link or image, its target, and an autolink.
CODE_SPAN = r"`[^`\n]*`"
MARKDOWN_LINK = (r"!?\[[^\[\]]*\]\([ \t\n]*(?:<([^<>\n]*)>|([^ \t\n()<>]+))(?:[ \t\n]+[^()]*)?\)"
                 r"|<([a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^ \t\n<>]*)>")
MARKDOWN_IMAGE = r"!\[[^\[\]]*\](?:\([^()]*\)|\[[^\[\]]*\])"
LINK_DEFINITION = r"(?m)^ {0,3}\[([^\[\]\n]+)\]:[ \t]*<?([^ \t\n<>]+)>?[^\n]*$"
# Link text; then a target in angle brackets, a plain target, or a label; or an autolink.
ANY_LINK = (r"\[([^\[\]]*)\](?:\([ \t\n]*(?:<([^<>\n]*)>|([^ \t\n()<>]+))(?:[ \t\n]+[^()]*)?\)|\[([^\[\]]*)\])?"
            r"|<([a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^ \t\n<>]*)>")

# Sentence boundary rule (stands in for a trained sentence splitter).
SENTENCE_END = r"[.!?]+[ \t\n\r\f]+"


def keyword_pattern(words: str, as_written: bool = True) -> str:
    """Case-insensitive alternation; ``as_written=False`` drops an empty alternative."""
    if not as_written:
        words = "|".join(w for w in words.split("|") if w)
    return f"(?iu)({words})"


def re2(pattern: str) -> str:
    """The RE2 spelling of a Java pattern built by this module.

    RE2 has no lookaround, so the spelled-out Unicode boundary becomes RE2's
    ASCII ``\b``: the two differ only where a URL's last label touches a
    non-ASCII letter or digit (``http://a.ioüber``), which the Java form,
    like Python, does not take as a URL.
    """
    return pattern.replace("(?iu)", "(?i)").replace("(?d)", "").replace(WORD_BOUNDARY, r"\b")


def sql_str(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
