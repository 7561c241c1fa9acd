"""Patterns and word lists that several operators share.

Fixed values: these strings and lists define the results, so they are stated plainly
and in one place. Patterns are in Java syntax without named groups; those without
look-around are valid RE2 as well.
"""

#: Section numbers: 161, 3.1.4, 20B, 337-II, 45(1)(a).
SECTION = r"\d+(?:\.\d+)*(?:[A-Z]{1,3})?(?:[-_][A-Za-z]{1,6})?(?:\([a-z\d]+\))*"

#: Words that long run-together tokens are cut into.
RUN_ON_WORDS = """
the of and or in to by as is be at on for with from not no any may shall such when who that this his its have has had
been under within without save unless where which their there into upon against between through during before after
above below other than each every all both either neither if so but can will would should could must act section
article rule clause chapter part schedule order force member members officer officers rank power powers duty duties
right rights person court police director general inspector sub government punjab pakistan purpose provision provisions
""".split()

#: Words that carry no topic within a document.
TOPIC_STOPWORDS = """
the of under which may any for me you your quote tell what whats please give show cite about section sections provision
provisions article articles clause clauses rule rules chapter chapters part parts schedule schedules sub subsection
subsections act acts code ordinance law laws is are in on to by and or an that this from with shall can could would
should must
""".split()

STOPWORDS = "the of and in to a an for on by no act order".split()

GENERIC_TITLE_WORDS = """
procedure evidence court courts rule rules code criminal civil police general order law laws national federal provincial
government ordinance authority council control substances force
""".split()

DOC_NOISE = """
amended amendment amendments upto repealed substituted first second third fourth fifth vol volume part jan feb mar apr
may jun jul july aug sep sept oct nov dec january february march april june august september october november december
""".split()

GROUP_NOISE = """
act acts ordinance code rules rule order policy regulation regulations law amendment amendments amended upto repealed
substituted first second third fourth fifth part vol volume no of the and for on to in by an a jan feb mar apr may jun
jul july aug sep sept oct nov dec
""".split()

#: Folder names and the document types they stand for, in order of precedence.
TYPE_OF_FOLDER = [("amendments", "amendment"), ("amendment", "amendment"), ("base_acts", "base_act"), ("acts", "base_act"), ("rules", "rules"), ("policy", "policy"), ("reference", "reference")]
AMENDMENT_TITLE = r"(?:first\s+)?amendment|amended\s+upto|amendment\s+act"
INSTRUMENT_WORDS = "act order code rules ordinance policy".split()
ROMAN = r"^(?:i{1,3}|iv|v|vi{0,3}|ix|x{1,3})$"

#: Short names and the title words they stand for.
ABBREVIATIONS = {
    "crpc": ["code", "criminal", "procedure"],
    "cnsa": ["control", "narcotic", "substances"],
    "cns": ["control", "narcotic", "substances"],
    "ppc": ["pakistan", "penal", "code"],
    "qso": ["qanun", "shahadat"],
    "amla": ["anti", "money", "laundering"],
    "aml": ["anti", "money", "laundering"],
    "anf": ["anti", "narcotics", "force"],
    "ppr": ["punjab", "police", "rules"],
    "dda": ["dangerous", "drugs"],
}

#: Marks of amendments in running text.
AMENDMENTS = [
    r"as amended by(?:\s+(?:Act|Section|the))?(?:\s+)(\S+\s+\d+[\w\(\)]*)",
    r"(?:amended|modified|substituted|replaced)\s+(?:by|with|through)(?:\s+(?:Act|Section|the))?(?:\s+)(\S+\s+\d+[\w\(\)]*)",
    r"now(?:\s+)?(?:reads?|provides?|states?):",
    r"(?:Sub-section|Clause|Paragraph)\s+(?:\d+[A-Za-z]*)\s+(?:inserted|added|substituted|omitted)",
]
AMENDED_NUMBER = r"(\d+(?:\.\d+)*(?:[-_][A-Za-z]+)?(?:\([a-z\d]+\))*)"

#: Questions: the first class with a pattern that is found wins; LOOKUP is tried on the last 1200 characters before all.
LOOKUP = r"\b(?:what|which|tell\s+me|define|explain|summarize|describe)\b[\s\S]{0,200}\b(?:section|article|rule)\s+[\w.\-()]+\b"
INTENTS = [
    ("comparison", [r"\bcompar(?:e|ing|ison)\b", r"\bdiff(?:er|erence|erent)\b", r"\bvs\.?\b", r"\bversus\b", r"\bbetween\b.*\band\b", r"\bhow\s+(?:do|does|is|are)\b.*\bdiffer\b", r"\bdistinguish\b", r"\bcontrast\b", r"\bsimilar(?:ity|ities)?\b", r"\bboth\b.*\band\b"]),
    ("penalty", [r"\bpunish(?:ment|able)?\b", r"\bpenalt(?:y|ies)\b", r"\bsentenc(?:e|ing)\b", r"\bimprison(?:ment)?\b", r"\bfine(?:s|d)?\b", r"\bconsequence(?:s)?\b", r"\boffence\b.*\bpunish\b", r"\bwhat\s+(?:is|are)\s+the\s+(?:punishment|penalty|consequence)"]),
    ("procedural", [r"\bprocedure\b", r"\bprocess\b", r"\bsteps?\s+(?:to|for|in|of)\b", r"\bhow\s+(?:to|do|does|is|can)\b", r"\bfil(?:e|ing)\s+(?:a|an|the)?\s*(?:case|complaint|appeal|petition)\b", r"\bwhat\s+is\s+the\s+(?:procedure|process)\b", r"\brequirements?\s+(?:for|to)\b", r"\bconditions?\s+(?:for|to|of)\b"]),
    ("cross_reference", [r"\brelat(?:ed|ing)\s+(?:sections?|provisions?|articles?)\b", r"\bcross[\s-]?referenc\b", r"\bprovisions?\s+(?:across|in\s+(?:other|different))\b", r"\bwhich\s+(?:sections?|articles?|rules?)\s+(?:relate|apply|govern)\b", r"\bapplicable\s+(?:sections?|articles?|laws?|provisions?)\b", r"\ball\s+(?:sections?|provisions?)\s+(?:about|regarding|on|related)\b"]),
    ("explanation", [r"\bexplain\b", r"\bwhat\s+does\b.*\bmean\b", r"\bmeaning\s+of\b", r"\binterpret(?:ation)?\b", r"\bdefin(?:e|ition)\b", r"\bscope\s+(?:of|and)\b", r"\bapplicability\b", r"\bwhen\s+does\b.*\bapply\b", r"\bpurpose\s+(?:of|behind)\b", r"\bwhy\b.*\b(?:enacted|created|introduced)\b"]),
]

#: A question for a provision of, under, in or from a named instrument.
DIRECTED = r"(?i)\b(?:sections?|provisions?|articles?|clauses?|sub-?sections?|rules?|chapters?|parts?|schedules?)\b\s+(?:no\.?\s+|number\s+)?(?:of|under|in|from)\b"

#: Lines: contents entries, page markers, clause starts.
CONTENTS_LINE = r"(?:\.{3,}|\s{3,}\d{1,4})\s*\d{0,4}\s*$"
PAGE_LINE = r"(?i)^\d{1,4}\s*\|\s*p\s*a\s*g\s*e\b|^p\s*a\s*g\s*e\s+\d{1,4}\b"
CLAUSE_LINE = r"(?i)^\(?(?:[a-z]|[ivxlcdm]{1,5}|\d{1,3}[A-Z]?)\)|^(?:Explanation|Provided|Illustration)s?\b"

EXTENSIONS = ".pdf .txt .md .csv .json .yaml .yml .log .rst .ini .toml .xml .html .htm".split()
