"""Regular expressions over source text (Java regex dialect).

Every repetition over arbitrary text is possessive: the regex engine then
loops instead of recursing, so the length of a text never becomes stack depth.
"""

LINE_COMMENT = r"//[^\n]*+"
BLOCK_COMMENT = r"/\*(?s:.*?)(?:\*/|\z)"
CLOSED_BLOCK_COMMENT = r"/\*(?s:.*?)\*/"
STRING = r'"[^"\\]*+(?:\\(?:[\s\S]|\z)[^"\\]*+)*+(?:"|\z)'
CHAR = r"'[^'\\]*+(?:\\(?:[\s\S]|\z)[^'\\]*+)*+(?:'|\z)"

COMMENT = f"{LINE_COMMENT}|{BLOCK_COMMENT}"
# A look at the next character spares trying the alternatives at every place.
MASK = rf"""(?=[/"'])(?:{COMMENT}|{STRING}|{CHAR})"""

# Annotation arguments: balanced parentheses, quotes respected. Java's expressions cannot
# recurse, so they are written out this deep; a file that goes deeper is set aside with an error.
ARG_LEVELS = 16
_ARG_TEXT = rf"""[^()"']++|{STRING}|{CHAR}"""


def _arguments(levels: int) -> str:
    inner = _ARG_TEXT
    for _ in range(levels - 1):
        inner = rf"{_ARG_TEXT}|\((?:{inner})*+\)"
    return rf"\((?:{inner})*+\)"


_ARGS = _arguments(ARG_LEVELS)
ANNOTATION = rf"@(?!interface\b)[\w$.]++(?:\s*+{_ARGS})?+"
ANNOTATION_PARTS = rf"@(?!interface\b)([\w$.]++)(?:\s*+({_ARGS}))?+"

# Text up to and including '{' or '}', and one statement up to '{', '}' or ';'.
# Comments, literals and annotations are atoms, so what they hold does not count.
_ATOM = rf"""{MASK}|(?=@){ANNOTATION}|[/@]"""
CHUNK = rf"""(?:[^{{}}"'/@]++|{_ATOM})*+[{{}}]?+"""
STATEMENT = rf"""(?:[^{{}};"'/@]++|{_ATOM})*+[{{}};]?+"""

# Fixed value: the modifier keywords that may stand before a declaration.
MODIFIERS = (
    "public|protected|private|static|final|abstract|synchronized|native|"
    "strictfp|transient|volatile|default|sealed|non-sealed"
)
DECL_PREFIX = rf"^(?:\s++|{COMMENT}|{ANNOTATION}|(?:{MODIFIERS})\b(?![\w$]))*+"
TYPE_HEADER = r"(?U)^(class|interface|enum)\s+([\w$]+)"
TYPE_HINT = r"(?=[cie])\b(?:class|interface|enum)\s"
# Unicode word boundaries are dear, so the next character is looked at first.
TYPE_ANCHOR = r"(?U)(?=[cie])\b(?:class|interface|enum)\s+"
# Applied after comments, annotations and generics are gone.
METHOD_HEADER = (
    r"(?U)^(?:(?!(?:new|return|throw|else|record|class|interface|enum)\b)([\w$]+)(?:\s*\.\s*[\w$]+)*"
    r"(?:\s*\[\s*\])*\s+)?([\w$]+)\s*\(([^()]*)\)(?:\s*\[\s*\])*\s*(?:throws\s[\w$.,\s]+)?[{;]$"
)
PACKAGE_OR_IMPORT = rf"^(?:\s++|{COMMENT}|{ANNOTATION})*+(package|import)\s"
DOC_COMMENT = r"/\*\*(?s:.*?)\*/"

# --- Fixed values: these must equal the published behaviour -----------------
BRANCH = r"(?U)(?=[ifwc&|])(?:\b(?:if|for|while|case|catch)\b|&&|\|\|)"
# The same in code not masked yet: its group is a branch, or empty where a comment or literal is passed over.
BRANCH_OR_MASK = rf"{BRANCH[:4]}(?=[ifwc&|/\"'])(?:({BRANCH[4:]})|{MASK})"
SECRET_NAME = r"(\w*(?:password|secret|apikey|api_key|token|credential)\w*)"
SECRET_PLACEHOLDER = r"(?iU)^\s*(|changeme|xxx+|todo|placeholder|\$\{.*\})\s*$"
SQL_KEYWORD = r"\b(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b"
CATCH_BLOCK = r"catch\s*\([^)]*\)\s*\{([^{}]*)\}"
# -----------------------------------------------------------------------------


# A quoted stretch holding a SQL keyword. Each branch starts with another character,
# so the possessive loops match exactly what the backtracking form would.
_QUOTED_CHAR = r'[^"\\]|\\[^\n]'
SQL_LITERAL = rf'(?iU)"(?:(?!{SQL_KEYWORD})(?:{_QUOTED_CHAR}))*+{SQL_KEYWORD}(?:{_QUOTED_CHAR})*+"'


def secret_assignment(type_prefix: str = r"String\s+") -> str:
    """Quoted value given to a credential-like name; ``type_prefix`` may be empty.

    The look-aheads for a '=' after the word and for the first letter only spare searches.
    """
    first = f"(?={type_prefix[0]})" if type_prefix[:2].isalpha() and "|" not in type_prefix else ""
    return rf'(?iU){first}\b{type_prefix}(?=\w++\s*+=){SECRET_NAME}\s*=\s*"([^"]*)"'
