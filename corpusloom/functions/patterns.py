"""Patterns, phrases and lists that must equal the reference's for equal results."""

# Wiki markup, applied in this order.
BREAK = r"<br\s?/>"
SUBSCRIPTS = [r"<sub[^>]*>[^<>]+</sub>", r"<sub[^<>]+/>"]
REFERENCES = [r"<ref[^>]*>[^<>]+</ref>", r"<ref[^<>]*/>", r"<ref[^<>]*>"]
PAIRED_TAG = r"<[^>]+>([^<>]+)</[^>]+>"
COMMENT = r"<!--[^<>]+-->\.?"
TEMPLATE = r"{{[^{}]+}}"
FILE_LINKS = [
    r"\[\[(File:|Image:)[^\[\]]+(\[\[[^\[\]]+]]([^\[\]]+)?)*]]",
    r"\[\[(File:|Image:)[^\[\]]+(\[[^\[\]]+]([^\[\]]+)?)*]]",
]
LABELLED_URL = r"\[https?://\S+\s(.+)]"
BARE_URL = r"\[https?://\S+]"
QUOTES = r"'{2,3}"
PIPED_LINK = r"\[\[(?!:?File:|Image:)([^\[\]]+)\|([^\[\]]+)]]"
PLAIN_LINK = r"\[\[(?!:?File:|Image:)([^\[\]]+)]]"
SPACES = r"\s{2,}"

# Articles.
XML_NAMESPACE = "http://www.mediawiki.org/xml/export-0.10/"
SOURCE_URL = "https://en.wikipedia.org/wiki/"
TITLE_PREFIX = "Sustainable Development Goal "
SECTIONS = ["background", "challenge", "society and culture", "overall progress", "= progress =", "tools", "covid-19 pandemic", "links with other sdgs", "organizations"]
SECTION_PRIORITY = ["general", "lead section", "background", "progress", "tools", "challenge", "covid-19 pandemic", "society and culture", "organizations", "links with other sdgs"]

# Masking rules as (pattern, replacement, limited). A limited rule replaces two matches at most.
INDICATOR_RULES = [
    (r'^(This|The) target has one indicator: [“”"]?[A-Za-z,()\-\s]+[“”"]?\.', "", False),
    (r"(\*\s?)Indicator\s[0-9]{1,2}\.[0-9a-z]{1,2}\.[0-9]{1,2}(\.[a-z])?\.?:?.+;;", "", True),
    (r'Indicator\s(is\s)?[0-9]{1,2}\.[0-9a-z]{1,2}\.[0-9]{1,2}(\.[a-z])?\.?\s(it\s)?is\s(the\s)?[“”"].+[“”"]\.', "", True),
    (r'Indicator\s(is\s)?[0-9]{1,2}\.[0-9a-z]{1,2}\.[0-9]{1,2}(\.[a-z])?\.?\sis\sthe\s[“”"].+[“”"]\.', "", True),
    (r"^.+Indicator\s[0-9]{1,2}\.[0-9a-z]{1,2}\.[0-9]{1,2}(\.[a-z])?\.?:?.+$", "", True),
    (r"(\*\s?)?[iI]ndicator\s[0-9]{1,2}\.[0-9a-z]{1,2}\.[0-9]{1,2}(\.[a-z])?\.?:?[^.]+\.", "", True),
    (r"^(\*\s?)?[iI]ndicator\s[0-9]{1,2}\.[0-9a-z]{1,2}\.[0-9]{1,2}(\.[a-z])?\.?:?[^.]+$", "", True),
    (r'[0-9]{1,2}\.[0-9a-z]{1,2}\.[0-9]{1,2}(\.[a-z])?\.?\sis\s(the\s)?[“”"].+[“”"]\.$', "", True),
]
LIST_RULES = [
    (r"\s\(?[a-z]\)", " ", False),
    (r"^\(?[a-z]\)", " ", False),
    (r"\s\[?[a-z]]", " ", False),
    (r"\(i+\)", " ", False),
    (r"\s\(?[0-9]{1,2}\)", " ", False),
    (r"\s?\[[0-9]{1,2}]", " ", False),
]
NUMBER_RULES_ONCE = [
    (r'["“”*]', "", False),
    (r"\W'", " ", False),
    (r"'\W", " ", False),
    (r"\s{2,}", " ", False),
]
NUMBER_RULES = [
    (r"(indicator\s+)?[0-9]{1,2}\.[a-z0-9]{1,2}\.[0-9]{1,2}(\([a-z]\))?", "indicator", True),
    (r"indicator [0-9]{1,2}\.[a-z0-9]{1,2}", "indicator", True),
    (r"^Target\s+[0-9]{1,2}\.[a-zA-Z0-9]{1,2}\.?", "The target", False),
    (r"(\.\s)Target\s+[0-9]{1,2}\.[a-zA-Z0-9]{1,2}\.?", r"\1The target", False),
    (r"([a-z:]\s)(SDG\s)?[tT]arget\s+[0-9]{1,2}\.[a-zA-Z0-9]{1,2}\.?", r"\1the target", False),
    (r"\([tT]arget\s+[0-9]{1,2}\.[a-zA-Z0-9]{1,2}\.?\)", "", False),
    (r"\([tT]argets? [0-9]{1,2}\.[a-zA-Z0-9]{1,2}\.?(, [0-9]{1,2}\.[a-zA-Z0-9]{1,2}\.?)* and [0-9]{1,2}\.[a-zA-Z0-9]{1,2}\.?\)", "", False),
    (r"[0-1]{1,2}\.[0-9a-z]{1,2}\s–", "", False),
    (r"[0-9]{1,2}\.[a-z0-9]{1,2}\.?: ", "", False),
    (r"(\.\s)Targets\s+[0-9]{1,2}\.[a-zA-Z0-9]{1,2}\.? through [0-9]{1,2}\.[a-zA-Z0-9]{1,2}\.?", r"\1The targets", False),
    (r"Target[s]?\s+[0-9]{1,2}\.[a-zA-Z0-9]{1,2}\.? and [0-9]{1,2}\.[a-zA-Z0-9]{1,2}\.?", "The targets", False),
    (r"[iI]ndicator\s+[0-9]{1,2}\.[a-zA-Z0-9]{1,2}\.?", "the target", False),
    (r"\((Sustainable Development Goal|SDG|Goal) [0-9]{1,2}( or (SDG|Goal) [0-9]{1,2})?\s?\)", "", False),
    (r"\((Sustainable Development Goal|SDG|Goal) [0-9]{1,2}( or (Global )?Goal [0-9]{1,2})?\s?\)", "", False),
    (r"\((Sustainable Development Goal|SDG|Goal) [0-9]{1,2}( or the goal)?\s?\)", "", False),
    (r"\((Sustainable Development Goal|SDG|Goal) [0-9]{1,2}\s?,", "(the goal", False),
    (r"^(Sustainable (Development )?Goal|SDG|Goal)\s+[0-9]{1,2}", "The goal", False),
    (r"(\.\s)(Sustainable Development Goal|SDG|Goal)\s+[0-9]{1,2}", r"\1The goal", False),
    (r"([a-z:,]\s)(Sustainable_Development_Goal|[A-Z]Sustainable Development Goal|SDG|sdg|Goal|SDG Goal)[\s_]+[0-9]{1,2}", r"\1the goal", False),
    (r"#Goal [0-9]{1,2}", "#Goal ", False),
    (r"\s+\([0-9]{1,2}\.[a-z0-9]{1,2}\.?\)\s+", " ", False),
    (r"\s{2,}", " ", False),
]
NUMBER_RULES_LINKS = [
    (r"\s+[0-9]{1,2}\.[a-z0-9]{1,2}\.?\s+", " ", False),
    (r"the goal ;", "", False),
    (r"\(((the goal|the target)\s*)+\)", "", False),
]
PHRASE_RULES = [
    (r"\s+", " ", False),
    (r"A proposal has been tabled in [0-9]{4} to delete the (indicator|target)\.?", "", True),
    (r"In [0-9]{4} it was proposed to delete the former\.?", "", True),
    (r"The [gG]oal has ([a-z\-]+|[0-9]+) targets and ([a-z\-]+|[0-9]+) indicators to measure progress( toward targets)?\.", "", True),
    (r"The [gG]oal has ([a-z\-]+|[0-9]+) indicators to measure progress toward targets\.", "", True),
    (r"(The|This) target (only )?(has|includes) (only )?(a )?([a-z\-]+|[0-9]+) ([iI]ndicator[s]?[:.\s()]*)?", "", False),
    (r"This target has ([a-z\-]+|[0-9]+) ([A-Z])", r"\2", False),
    (r"^(Its [a-z]+ )?[iI]ndicators are:\s*;*$", "", False),
    (r"It has (only )?([a-z]+|[0-9]+) [iI]ndicator[s]?[:.\s()]*", "", False),
    (r"The ([a-z\-]+|[0-9]+\s)?targets are:\s*", "", False),
    (r"^Long (version|title):\s*", "", False),
    (r"The full[\s\-](text|title|main aim) (of|for) (the|this) (goal|target)(\sis)?(\sto)?:?\s*", "", False),
    (r"The full[\s\-](text|title)( the target)? is:?\s*", "", False),
    (r"^The target is( to| formulated as)?:?\s*", "", False),
    (r"^The text of the target is:?\s*", "", False),
    (r"^The goal is to:\s*", "", False),
    (r"The official (title|target|wording|text)( (of|for) the (goal|target))?(\sis)?:?", "", False),
    (r"The ([a-z]+|[0-9]+) outcome(-related|-oriented)? targets (are|include):?\s*", "", False),
    (r"The first ([a-z]+|[0-9]+) targets are outcome targets:?\s*", "", False),
    (r"The ([a-z]+|[0-9]+) target[s]? of the goal (is|are) the target[s]?:?\s*", "", False),
    (r"The goal has ([a-z]+|[0-9]+)( outcome)? targets:?\s*", "", False),
    (r"^There (is|are) ([a-z\-]+|[0-9]+) indicator[s]?:?\s*$", "", False),
    (r"^The ([a-z]+|[0-9]+) indicator[s]? (are|include):?\s*(The\s*)?$", "", False),
    (r"^Indicator[s]? (are|include):\s*$", "", False),
    (r'["“”*]', "", False),
    (r"\s'", " ", False),
    (r"'\s", " ", False),
    (r"^#\s", "", False),
    (r"\s+", " ", False),
    (r"([tT]he\s)([tT]he\s)+", r"\1", False),
]

# Sentences.
ABBREVIATIONS = [
    (r"e\.g\.", "e~g~"),
    (r"i\.e\.", "i~e~"),
    (r"(\W)etc\.(\W+[^A-Z])", r"\1etc~\2"),
    (r"(\W)etc\.$", r"\1etc~"),
    (r"(\W)([A-Za-z])\.([A-Za-z])\.(\W)", r"\1\2~\3~\4"),
    (r"([a-zA-Z)])\.([A-Z])", r"\1. \2"),
    (r"([0-9)]{3,})\.([A-Z])", r"\1. \2"),
]
ABBREVIATIONS_BACK = [
    (r"e~g~", "e.g."),
    (r"i~e~", "i.e."),
    (r"(\W)etc~(\W+[^A-Z])", r"\1etc.\2"),
    (r"(\W)etc~$", r"\1etc."),
    (r"(\W)([A-Za-z])~([A-Za-z])~(\W)", r"\1\2.\3.\4"),
]
SEPARATORS = r"\. |\? |! |;; "

# Identifiers.
GOAL_ID = r"([0-9]{1,2})([.][0-9a-z]{1,2}[.][0-9]{1,2})"
TARGET_ID = r"([0-9]{1,2}[.][0-9a-z]{1,2})([.][0-9]{1,2})"
TARGET_LABEL = r"^[0-9]{1,2}[.][0-9a-z]{1,2}\z"
