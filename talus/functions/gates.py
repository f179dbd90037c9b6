"""Gates and classification rules over postings: ordered reason chains of regular
expressions. Matching is case-insensitive with Unicode letters, whatever the JDK."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ------------------------------------------------------------------ fixed values
# Phrases and word lists that decide the gates. They must stay as they are for equal results.
SENIOR_HARD = r"director|head of|chief|vice president|distinguished|c-level|cxo|president"
SENIOR_VP = r"vp"
SENIOR_SOFT = r"senior|sr\.?|lead"
SENIOR_PARTNER = r"partner"
JUNIOR = (
    r"intern|internship|stage|stagista|stagiaire|praktikum|praktikant|tirocinio|tirocinante|junior|jr\.?|graduate|associate|fellowship"
    r"|trainee|rotational|entry.?level|analyst|apprenti"
)
ALWAYS_ACCEPTED = (
    r"product manager|hr analytics manager|people analytics manager|workforce planning manager|business analyst|hr data analyst"
    r"|people data analyst|hr reporting manager|talent analytics manager"
)
OVERQUALIFIED = r"([5-9]|1[0-9])\+\s*years?\s*(?:of\s+)?(?:experience|exp)"
INTERN = (
    r"intern|internship|working[\s\-]?student|werkstudent|graduate(?:\s+program)?|trainee|apprentice|apprenticeship|stage|stagiaire"
    r"|praktikum|praktikant|tirocinio|tirocinante"
)
TRACK_SENIOR = (
    r"analyst|associate|specialist|coordinator|junior|manager|lead|principal|director|head(?:\s+of)?|vp|vice[\s\-]?president|chief|partner"
)
PREFILTER_SENIOR = r"senior|sr\.?|staff|principal|lead|head\s+of|director|vice[\s-]?president|vp|chief|distinguished|president"
ROLE_KEYWORDS = ["ai", "artificial intelligence", "machine learning", "product", "strategy", "transformation", "analytics", "data", "innovation"]
TRACK_A = ["ai_strategy", "product_management", "digital_transformation", "business_strategy"]
TRACK_B = ["workforce_strategy", "hr_transformation", "people_analytics", "hr_analytics", "workforce_planning", "talent_acquisition"]
NOT_EUROPE = (
    r"united states|usa|u\.s\.a|us|new york|nyc|san francisco|sf|los angeles|chicago|chi|boston|seattle|sea|austin|atlanta|atl|canada|toronto"
    r"|vancouver|montreal|india|bangalore|bengaluru|mumbai|delhi|hyderabad|pune|china|beijing|shanghai|singapore|tokyo|japan|hong kong"
    r"|australia|sydney|brazil|s[aã]o paulo|mexico|dubai|uae|middle east|apac|latam|mena"
)
EUROPE = (
    r"remote|hybrid|europe|european|anywhere|home office|italy|italia|uk|united kingdom|germany|deutschland|france|netherlands|spain|ireland"
    r"|switzerland|belgium|sweden|denmark|finland|norway|poland|austria|portugal|czech(?:ia)?|hungary|romania|bulgaria|lithuania|latvia"
    r"|estonia|greece|cyprus|croatia|slovakia|slovenia|luxembourg|malta|milan|milano|london|amsterdam|berlin|paris|barcelona|dublin|zurich"
    r"|rome|roma|munich|münchen|lyon|marseille|madrid|vienna|wien|stockholm|copenhagen|oslo|helsinki|brussels|warsaw|lisbon|zagreb|m[aá]laga"
    r"|d[uü]sseldorf|hamburg|frankfurt|budapest|sofia|vilnius|riga|athens|antwerp|nantes|le[oó]n|nicosia|edinburgh|crawley|cologne|k[oö]ln"
    r"|stuttgart|tallinn|bratislava|ljubljana|valencia|seville|sevilla|porto|gothenburg|aarhus|rotterdam|eindhoven|the hague|den haag|utrecht"
    r"|krak[oó]w|wroc[lł]aw|gda[nń]sk|toulouse|bordeaux|nice|glasgow|manchester|cambridge|oxford|geneva|basel|lausanne|bologna|turin|torino"
    r"|florence|firenze"
)
GENERIC_REMOTE = r"remote|anywhere|worldwide|home[\s-]?office|work\s+from\s+home|wfh|europe|european|emea|pan[\s-]?european"
#: Place names by country, for a focus on some countries; callers may pass their own.
PLACES = {
    "it": r"ital(?:y|ia)|provincia\s+di|citt[aà]\s+metropolitana|piemonte|piedmont|lombardi[ay]|lazio|toscana|tuscany|veneto|emilia|milan|milano|rom[ae]"
    r"|turin|torino|naples|napoli|bologna|florence|firenze|venice|venezia|genoa|genova|bari|palermo|verona|padua|padova|brescia|bergamo|modena|catania"
    r"|novara|como|monza|varese|pavia|cremona|mantova|parma|rimini|piacenza|cameri",
    "nl": r"netherlands|nederland|holland|noord[\s-]?holland|zuid[\s-]?holland|noord[\s-]?brabant|gelderland|overijssel|limburg|friesland|drenthe|zeeland"
    r"|flevoland|amsterdam|rotterdam|the\s+hague|den\s+haag|utrecht|eindhoven|groningen|tilburg|breda|nijmegen|haarlem|arnhem|delft|leiden|hilversum"
    r"|almere|maastricht|amersfoort|apeldoorn|zwolle|enschede|zaandam|'?s[\s-]?hertogenbosch|den\s+bosch",
    "de": r"german(?:y)?|deutschland|berlin|munich|m[uü]nchen|hamburg|frankfurt|cologne|k[oö]ln|stuttgart|d[uü]sseldorf|hannover|leipzig",
    "fr": r"france|paris|lyon|marseille|toulouse|bordeaux|nantes|nice|lille|strasbourg",
    "es": r"spain|espa[nñ]a|madrid|barcelona|valencia|seville|sevilla|m[aá]laga|bilbao",
    "gb": r"united\s+kingdom|uk|england|scotland|wales|london|manchester|cambridge|oxford|edinburgh|glasgow|birmingham|leeds|bristol|crawley",
    "ie": r"ireland|dublin", "ch": r"switzerland|zurich|z[uü]rich|geneva|basel|lausanne|bern", "be": r"belgium|brussels|antwerp|ghent|leuven",
    "at": r"austria|vienna|wien", "pt": r"portugal|lisbon|lisboa|porto", "se": r"sweden|stockholm|gothenburg|malm[oö]",
    "dk": r"denmark|copenhagen|aarhus", "no": r"norway|oslo", "fi": r"finland|helsinki", "pl": r"poland|warsaw|krak[oó]w|wroc[lł]aw|gda[nń]sk",
    "cz": r"czech(?:ia)?|prague", "hu": r"hungary|budapest", "ro": r"romania|bucharest|cluj(?:-napoca)?|timisoara|iasi",
    "bg": r"bulgaria|sofia", "lt": r"lithuania|vilnius", "lv": r"latvia|riga", "ee": r"estonia|tallinn", "cy": r"cyprus|nicosia", "hr": r"croatia|zagreb",
    "sk": r"slovakia|bratislava", "si": r"slovenia|ljubljana", "lu": r"luxembourg", "mt": r"malta|valletta", "gr": r"greece|athens",
}
SOFT_WINDOW = 80
SOFTENERS = (
    r"is\s+a\s+(nice[- ]to[- ]have|bonus|plus)|would\s+be\s+(a\s+)?(plus|bonus|advantage|asset)|(?<!\w)(a\s+)?(plus|bonus|advantage|asset)(?!\w)"
    r"|preferred\b|preferable\b|desirable\b|advantageous\b|nice[- ]to[- ]have\b|not\s+(required|mandatory|essential|obligatory|compulsory)\b"
    r"|if\s+possible\b|ideally\b|optionally\b|welcome\b(?!\s+to\s+apply)"
)
LANGUAGE = (
    r"(?:italian|italiano|german|deutsch|tedesco|french|fran[çc]ais|francese|dutch|nederlands|flemish|vlaams|spanish|espa[nñ]ol|spagnolo"
    r"|castellano|portuguese|portugu[eê]s|mandarin|chinese|arabic|polish|czech|romanian|hungarian|swedish|norwegian|danish|finnish|russian"
    r"|turkish|korean|japanese|hebrew|greek|catalan)"
)
REQUIRED = (
    r"(?:required|mandatory|essential|must(?:\s+be)?|compulsory|obligatory|richiesto|erforderlich|indispensable|indispensabile|obligatoire"
    r"|imprescindible|necessario)"
)
LANGUAGE_GATE = [
    ("language_required", r"\bLANG\s+(?:language\s+)?(?:is\s+)?REQ\b"),
    ("language_required_colon", r"\bREQ:\s*LANG\b"),
    ("fluent_language", r"\bfluent\s+(?:in\s+)?LANG\b"),
    ("must_use_language", r"\b(?:must|need(?:ed)?|required|expected)\s+(?:to\s+)?(?:speak|write|communicate\s+in|work\s+in)\s+LANG\b"),
    ("language_proficiency_required", r"\bLANG\s+(?:language\s+)?(?:proficiency|fluency|command)\s+(?:is\s+)?REQ\b|\b(?:proficiency|fluency|command)\s+in\s+LANG\s+(?:is\s+)?REQ\b"),
    ("language_speaking_role", r"\bLANG[\s-]+speaking\b"),
    ("native_language", r"\bnative\s+(?:\w+\s+){0,2}LANG\b"),
    ("language_native", r"\bLANG\s+(?:\w+\s+){0,2}(?:native|madrelingua|muttersprache)\b"),
    ("c1c2_language", r"\b[Cc][12]\s+LANG\b|\bLANG\s+[Cc][12]\b"),
    ("b2_language", r"\b[Bb]2\s+LANG\b|\bLANG\s+[Bb]2\b"),
    ("mother_tongue", r"\bmother[\s-]tongue\b"),
    ("native_speaker", r"\bnative\s+speaker\b(?!\s+of\s+(?:the\s+)?english)(?<!\benglish\s)"),
    ("local_language_required", r"\blocal\s+language\s+(?:is\s+)?(?:a\s+)?REQ"),
    ("mother_tongue_specific", r"\b(?:madrelingua\s+italiana?|muttersprache\s+deutsch|langue\s+maternelle|moedertaal|lengua\s+materna)\b"),
    ("language_prerequisite", r"\bLANG\s+language\s+(?:is\s+)?(?:a\s+)?(?:requirement|prerequisite)\b"),
    ("language_speakers_only", r"\b(?:only\s+)?LANG\s+speakers?\s+only\b|\bonly\s+LANG\s+speakers?\b"),
    ("language_level_parenthetical", r"\bLANG\s*\(\s*(?:fluent|fluency|native|mother[\s-]?tongue|c[12]|b2)\s*\)"),
]
NEEDED = r"(?:required|mandatory|essential|must|needed)"
VISA_GATE = [
    ("eu_citizenship_required", r"\bEU\s+(?:citizenship|citizen|passport|national(?:ity)?|membership)\s+(?:is\s+)?(?:required|mandatory|essential|must|needed|necessary)\b"),
    ("must_be_eu_citizen", r"\bmust\s+(?:be\s+(?:an?\s+)?EU\s+(?:citizen|national)|hold\s+(?:an?\s+)?EU\s+(?:citizenship|passport))\b"),
    ("must_have_work_authorization", r"\bmust\s+(?:already\s+)?(?:have|hold|possess)\s+(?:(?:existing|valid|current)\s+)?(?:work\s+authori[zs]ation|authoris?ation\s+to\s+work|work\s+permit)\b"),
    ("work_authorization_required", r"\b(?:existing\s+)?work\s+authori[zs]ation\s+(?:is\s+)?NEED\b"),
    ("right_to_work_required", r"\bright\s+to\s+work\s+(?:in\s+\w+(?:\s+\w+)?\s+)?(?:is\s+)?NEED\b|\bmust\s+have\s+(?:the\s+)?right\s+to\s+work\b"),
    ("no_visa_sponsorship", r"\bno\s+(?:visa\s+)?sponsorship\b|\bvisa\s+sponsorship\s+(?:is\s+)?(?:not\s+(?:available|offered|provided|possible)|unavailable)\b|\bsponsorship\s+(?:is\s+)?(?:not\s+available|unavailable|not\s+offered|not\s+provided|not\s+possible)\b"),
    ("cannot_sponsor", r"\b(?:cannot|can\s+not|can[']t|unable\s+to|do\s+not|don[']t|will\s+not|won[']t|not\s+able\s+to)\s+(?:provide\s+)?(?:visa\s+)?sponsor(?:ship)?\b"),
    ("work_permit_required", r"\bwork\s+permit\s+(?:is\s+)?(?:required|mandatory|essential|must)\b|\bmust\s+(?:already\s+)?have\s+(?:a\s+)?(?:valid\s+)?work\s+permit\b"),
    ("swiss_authorization_required", r"\bSwiss\s+(?:work\s+)?(?:authoris?ation|permit|residence\s+permit)\s+(?:is\s+)?(?:required|mandatory|must)\b"),
    ("eu_residents_only", r"\b(?:only\s+)?EU\s+residents?\s+only\b|\bopen\s+(?:only\s+)?to\s+EU\s+(?:residents?|citizens?|nationals?)\b|\bfor\s+EU\s+(?:residents?|citizens?|nationals?)\s+only\b"),
    ("candidate_authorization_required", r"\bcandidates?\s+must\s+have\s+(?:existing\s+)?(?:authoris?ation|authorization|permission)\s+to\s+work\b"),
]


def has(text: Column, words: str) -> Column:
    """Is one of the phrases in the text as whole words; false for null."""
    return F.coalesce(text.rlike(rf"(?iuU)\b(?:{words})\b"), F.lit(False))


def _first(cases: list[tuple[Column, bool, str]], default: tuple[bool, str]) -> Column:
    """struct(ok, reason) of the first case that holds."""
    pair = lambda ok, reason: F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"))
    out = None
    for condition, ok, reason in cases:
        out = F.when(condition, pair(ok, reason)) if out is None else out.when(condition, pair(ok, reason))
    return out.otherwise(pair(*default))


# ------------------------------------------------------------------ native gates
def excluded_keyword(title: Column, keywords: list[str]) -> Column:
    """The first keyword that the title holds as a whole word, else null."""
    return F.coalesce(*[F.when(has(title, re.escape(k)), F.lit(k)) for k in keywords], F.lit(None).cast("string"))


def seniority(title: Column, description: Column) -> Column:
    return _first(
        [
            (has(title, ALWAYS_ACCEPTED), True, "always_accept"),
            (has(title, SENIOR_HARD), False, "hard_reject_title"),
            (has(title, SENIOR_VP), False, "vp_reject"),
            (has(title, SENIOR_PARTNER) & ~has(title, JUNIOR), False, "partner_reject"),
            (has(F.substring(description, 1, 1000), OVERQUALIFIED), False, "overqualified_desc"),
            (has(title, SENIOR_SOFT) & ~has(title, JUNIOR), False, "soft_reject_no_accept"),
            (has(title, JUNIOR), True, "accept_title"),
            (has(F.substring(description, 1, 500), JUNIOR), True, "accept_desc"),
        ],
        (False, "no_accept_signal"),
    )


def seniority_by_track(title: Column, description: Column, track: Column) -> Column:
    interns = _first([(has(title, INTERN), True, "intern_accept"), (has(title, TRACK_SENIOR), False, "seniority_reject")], (False, "no_accept_signal"))
    return F.when(track.isin("A", "B"), interns).otherwise(seniority(title, description))


def _missing(location: Column) -> Column:
    return location.isNull() | (location == "")


def geography(location: Column, focus: list[str] | None = None) -> Column:
    """Strict: with a focus only its countries and remote postings that name no other place;
    without, what is in Europe or open to anywhere. A missing location passes."""
    cases = [(_missing(location), True, "no_location")]
    if focus:
        others = "|".join(v for k, v in PLACES.items() if k not in focus)
        cases += [
            (has(location, "|".join(PLACES[k] for k in focus)), True, "in_focus"),
            (has(location, GENERIC_REMOTE) & ~has(location, others) & ~has(location, NOT_EUROPE), True, "remote_in_focus"),
        ]
        return _first(cases, (False, "outside_focus"))
    cases += [
        (has(location, NOT_EUROPE) & has(location, "anywhere|worldwide"), True, "remote_worldwide"),
        (has(location, NOT_EUROPE), False, "non_eu"),
        (has(location, EUROPE), True, "eu"),
    ]
    return _first(cases, (False, "unknown_reject"))


def outside_focus(location: Column, focus: list[str] | None = None) -> Column:
    """Coarse: only places that are clearly outside; missing and unknown ones stay."""
    if focus:
        others = "|".join(v for k, v in PLACES.items() if k not in focus)
        away = has(location, others) | (has(location, NOT_EUROPE) & ~has(location, GENERIC_REMOTE))
        return ~_missing(location) & ~has(location, "|".join(PLACES[k] for k in focus)) & away
    return ~_missing(location) & has(location, NOT_EUROPE) & ~has(location, "anywhere|worldwide")


def track(category: Column) -> Column:
    return F.when(category.isin(TRACK_A), "A").when(category.isin(TRACK_B), "B").otherwise("unclassified")


def language_rule(lang: Column, confidence: Column, category: Column) -> Column:
    """struct(ok, reason) by track: low confidence and English pass, Italian for track B."""
    pair = lambda ok, reason: F.struct(F.lit(ok).alias("ok"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    return (
        F.when(confidence < 0.85, pair(True, "low_confidence")).when(lang == "en", pair(True, "english"))
        .when((lang == "it") & category.isin(TRACK_B), pair(True, "italian_track_b"))
        .when((lang != "en") & category.isin(TRACK_A), pair(False, F.concat(F.lit("non_en_track_a:"), lang)))
        .otherwise(pair(True, "default_accept"))
    )


def role_rejected(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    any_word = F.lit(False)
    for word in ROLE_KEYWORDS:
        any_word = any_word | F.contains(low, F.lit(word))
    return ~any_word


def is_intern(title: Column) -> Column:
    return has(title, INTERN)


def senior_title(title: Column) -> Column:
    return has(title, PREFILTER_SENIOR) & ~is_intern(title)


def sponsorship(visa_gate: Column) -> Column:
    gate = F.upper(F.coalesce(visa_gate, F.lit("")))
    return F.when(gate == "PASS", "Likely").when(gate == "FAIL", "No").otherwise("Unknown")


# ------------------------------------------------------------------ gates that need offsets
GATE = T.StructType(
    [
        T.StructField("ok", T.BooleanType()), T.StructField("label", T.StringType()), T.StructField("snippet", T.StringType()),
        T.StructField("softened", T.ArrayType(T.StringType())),
    ]
)


#: Lower-case letters of which every match of a pattern holds one, by label; patterns with LANG need one of LANGUAGE_STEMS and of LANGUAGE_ALSO.
STEMS = {
    "mother_tongue": ["tongue"], "native_speaker": ["native"], "local_language_required": ["local"], "mother_tongue_specific": ["madrelingua", "muttersprache", "maternelle", "moedertaal", "materna"],
    "eu_citizenship_required": ["eu "], "must_be_eu_citizen": ["must "], "must_have_work_authorization": ["work"], "work_authorization_required": ["authori"], "right_to_work_required": ["right"],
    "no_visa_sponsorship": ["sponsor"], "cannot_sponsor": ["sponsor"], "work_permit_required": ["permit"], "swiss_authorization_required": ["swiss"], "eu_residents_only": ["eu "],
    "candidate_authorization_required": ["candidate"],
}
LANGUAGE_ALSO = {
    "language_required_colon": [":"], "fluent_language": ["fluent"], "must_use_language": ["speak", "write", "communicate", "work"], "language_proficiency_required": ["proficiency", "fluency", "command"],
    "language_speaking_role": ["speaking"], "native_language": ["native"], "language_native": ["native", "madrelingua", "muttersprache"], "c1c2_language": ["c1", "c2"], "b2_language": ["b2"],
    "language_prerequisite": ["requirement", "prerequisite"], "language_speakers_only": ["speaker"], "language_level_parenthetical": ["("],
}
LANGUAGE_STEMS = (
    "italian german deutsch tedesco french fran dutch nederlands flemish vlaams spanish espa spagnolo castellano portugu mandarin chinese arabic polish czech romanian"
    " hungarian swedish norwegian danish finnish russian turkish korean japanese hebrew greek catalan"
).split()
#: Letters that patterns take for ASCII ones in either case, but lower() doesn't.
FOLDED = re.compile("[\u017f\u0130\u0131\u212a]")

_TABLES: dict[str, list[tuple[str, re.Pattern]]] = {}  # compiled once for each worker


def _compiled(name: str, table: list[tuple[str, str]]) -> list[tuple[str, re.Pattern]]:
    full = lambda p: p.replace("LANG", LANGUAGE).replace("REQ", REQUIRED).replace("NEED", NEEDED)
    if name not in _TABLES:
        _TABLES[name] = [(label, re.compile(full(p), re.I)) for label, p in table]
    return _TABLES[name]


def _shown(text: str | None) -> str:
    """The text without tags, with its character references decoded and white space as one
    space, so that phrases match across markup."""
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", text or "")).split())


def _judge(texts: pd.Series, table: list[tuple[str, re.Pattern]]) -> pd.DataFrame:
    """First match, in the order of the table, without a softener in the characters after
    it; and the labels whose matches have one."""
    soft = re.compile(rf"\b(?:{SOFTENERS})\b", re.I)
    out, seen = [], {}
    for raw in texts:
        if raw in seen:  # texts of this batch that repeat
            out.append(seen[raw])
            continue
        text = _shown(raw)
        low, odd = text.lower(), FOLDED.search(text) is not None
        language = odd or any(stem in low for stem in LANGUAGE_STEMS)
        ok, label, snippet, softened = True, None, None, []
        if len(text) >= 5:
            for name, pattern in table:
                # Patterns that can't match are not searched for.
                stems = STEMS.get(name) or LANGUAGE_ALSO.get(name)
                if not odd and (name not in STEMS and not language or stems and not any(stem in low for stem in stems)):
                    continue
                for m in pattern.finditer(text):
                    if soft.search(text[m.end() : m.end() + SOFT_WINDOW]):
                        softened.append(name)
                    elif ok:
                        ok, label, snippet = False, name, m[0].strip()[:60]
        seen[raw] = (ok, label, snippet, sorted(set(softened)))
        out.append(seen[raw])
    return pd.DataFrame(out, columns=["ok", "label", "snippet", "softened"])


@F.pandas_udf(GATE)
def language_gate(texts: pd.Series) -> pd.DataFrame:
    """Fails on a language other than English that is required; markup is taken off first."""
    return _judge(texts, _compiled("language", LANGUAGE_GATE))


@F.pandas_udf(GATE)
def visa_gate(texts: pd.Series) -> pd.DataFrame:
    """Fails on work permits that are required or sponsorship that is refused."""
    return _judge(texts, _compiled("visa", VISA_GATE))
