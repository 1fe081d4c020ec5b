"""Personal information inside free text: mentions, and placeholders that keep equal values linked.

Mentions are found by shape and surroundings. Numbers have the formats of their countries or a label before them. Addresses have a street word, a number and, where there are, town and
code. Two capitalised words are a person by what stands around them (labels, verbs of contact and speech, greetings, signatures, contact details beside them, a person
just before) or by a frequent given name, unless one of them is a word of no name; Korean names stand before forms of address, particles with verbs of speech, or behind labels.

A placeholder names the type and carries a pseudonym. Numbers are permuted within their format by a keyed Feistel network: phone numbers keep their layout and prefix and
change their last seven digits, identity numbers keep their layout, and a date in one becomes another valid date. Numbers that pass the check of their kind (a real date,
a check letter, a check digit) become others that pass it, the check recomputed; those that fail become others that fail. The permutation
depends on the digits alone, so one number in two layouts has the same digits afterwards. Other values get a keyed 128-bit digest of their plain form. A number that fails its
check is replaced all the same: numbers that were never issued are what people write down for examples, and to leave one in place costs more than to take it out.

Defined results: null, empty and blank texts have no mentions and stay as they are; overlapping mentions are settled in the order email, identity number,
address, phone, name; texts of any length are read whole; repeated rows are treated alike; extra columns are ignored; an empty secret is refused.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "id_number", "address", "phone", "name")
ROUNDS = 10

# one character for one, so that places stay the same
_WIDE = "\uff20\uff08\uff09\uff0d\uff0b\uff0e\uff0f\uff1a"  # full-width @ ( ) - + . / :
_DASHES, _BLANKS = "\u2010\u2011\u2012\u2013\u2212", "\u00a0\u2009\u202f\u3000"
_PLAIN = (
    {ord("\uff10") + n: ord("0") + n for n in range(10)}
    | {ord(c): ord(c) - 0xFEE0 for c in _WIDE}
    | {ord(c): ord("-") for c in _DASHES}
    | {ord(c): ord(" ") for c in _BLANKS}
)

# ---- emails

_AT = r"(?:@|[ ]?\[at\][ ]?|[ ]?\(at\)[ ]?|[ ]at[ ])"
_DOT = r"(?:\.|[ ]?\[dot\][ ]?|[ ]?\(dot\)[ ]?|[ ]dot[ ])"
EMAIL = re.compile(
    rf"(?<![A-Za-z0-9_.+%@/-])([A-Za-z0-9][A-Za-z0-9_.+%-]*)({_AT})((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?{_DOT})+[A-Za-z]{{2,24}})(?![A-Za-z0-9]|-[A-Za-z0-9])", re.I
)
_LOGIN = re.compile(r"\b(?:ssh|scp|sftp|rsync|mosh|telnet)(?: -\S+)* $", re.I)

# ---- identity numbers

ID_NUMBER = re.compile(
    r"""(?<![A-Za-z0-9./-])(?:
      (?P<rrn>\d{6}[ ]?-[ ]?[1-8]\d{6})
    | (?P<ssn>\d{3}-\d{2}-\d{4})
    | (?P<nino>(?:QQ|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z])[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D])
    | (?P<tax>\d{2}/\d{3}/\d{5})
    | (?P<dni>\d{8}-?[TRWAGMYFPDXBNJZSQVHLCKE])
    | (?P<passport>[A-Z]\d{8})
    )(?![A-Za-z0-9]|[-./]\d)""",
    re.X,
)
# digits that only a word before them makes an identity number
LABELLED = re.compile(
    r"""\b(?:SSN|social\ security(?:\ (?:no\.?|number))?|NI\ number|national\ ID|tax\ ID|TIN|passport(?:\ (?:no\.?|number))?|Steuer-?ID|Steuernummer|Ausweis(?:nummer|-Nr\.?)?
      |Personalausweis|Sozialversicherungsnummer|DNI|NIE|NIF|주민(?:등록)?번호|여권(?:번호)?|등록번호)[ ]?[:#]?[ ]?
      (?P<number>[A-Z]{0,2}\d(?:[ /-]?\d){5,13}(?:[ ]?[A-Z])?)(?![A-Za-z0-9])""",
    re.X | re.I,
)

# ---- phone numbers

PHONE = re.compile(
    r"""(?<![A-Za-z0-9./+-])(?<!\d[ ])(?:
      (?:\+|00(?=\d{1,3}[ ]))[1-9]\d{0,2}[ .-]?(?:\(0?\d{1,4}\)|\d{1,4})(?:[ ./-]?\d{2,5}){1,5}
    | (?:1[ .-])?(?:\([2-9]\d{2}\)[ ]?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}
    | \(0\d{2,4}\)[ ]?\d{3,8}(?:[ -]\d{2,5}){0,2}
    | 0[1-9](?:[ .-]\d{2}){4}
    | 0\d{2,3}/\d{6,8}
    | 0[1-9]\d?(?:[ .-])\d{3,4}(?:[ .-])\d{4}
    | 0[1-9]\d{0,3}[ ]\d{4,8}[ -]\d{2,4}
    | 01\d[.-]?\d{3,4}[.-]?\d{4}
    )(?!\d|[-./]\d|[ ]\d{2,}|\w*[A-Za-z])""",
    re.X,
)

# any layout, where a word before it says what it is
CALLED = re.compile(
    r"(?:\b(?:tel|phone|mobile|cell|fax|call|telefon|telefono|teléfono|téléphone|tél|handy|móvil)\b|전화(?:번호)?|연락처|휴대폰|電話(?:番号)?)\.?[ ]?[:：]?[ ]?(?P<number>\+?\(?\d[\d ()./-]{5,20}\d)(?![\d-]|[./]\d|\w*[A-Za-z])",
    re.I,
)

# ---- addresses

_CAP = r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]*"
# a town is no code: it has small letters
_TOWN_WORD = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-][A-Za-zÀ-ÖØ-öø-ÿ'’-]*"
_OF = r"(?:de\ la\ |de\ las\ |de\ los\ |de\ l['’]|della\ |delle\ |dei\ |del\ |dell['’]|des\ |du\ |de\ |di\ |d['’]|la\ |le\ |les\ |las\ |los\ )?"
_CITY = rf"(?:,\ (?:[A-Z]-)?\d{{5}}\ {_TOWN_WORD}(?:[\ -]{_TOWN_WORD})?)?"
_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Floor)"
_ROAD = (
    r"(?:(?:Street|Avenue|Road|Lane|Drive|Court|Boulevard|Place|Square|Terrace|Way|Close|Crescent|Row|Hill|Parkway)(?![A-Za-z])|(?:St|Ave|Rd|Ln|Dr|Ct|Blvd|Pl|Sq|Pkwy)(?![A-Za-z])\.?)"
)
ADDRESS = re.compile(
    rf"""(?<![\w.-])(?:
      (?:{_UNIT}\ \w+,\ )?\d{{1,5}}[A-Za-z]?\ (?:{_CAP}\ ){{1,3}}{_ROAD}(?:,?\ {_UNIT}\ \w+)?(?:,\ (?P<town>{_TOWN_WORD}(?:\ {_TOWN_WORD})?)(?:,?\ (?:[A-Z]{{2}}\ )?\d{{5}}(?:-\d{{4}})?|,?\ [A-Z]{{1,2}}\d\w?\ ?\d[A-Z]{{2}}\b)?)?(?:\ \d{{5}})?
    | {_CAP}(?:\ ?[Ss]traße|[Ss]tr\.|\ Str\.|gasse|\ Gasse|weg|\ Weg|allee|\ Allee|platz|\ Platz|ring|ufer|damm)\ \d{{1,4}}\ ?[a-z]?\b(?:,?\ (?:D-)?\d{{5}}\ {_CAP}(?:\ (?:am|an\ der|im|in\ der|bei|ob\ der|vor\ der)\ {_CAP})?)?
    | (?:(?:Am|An|Im|In|Auf|Zum|Zur|Unter|Vor|Hinter|Alte[rn]?|Neue[rn]?|Kleine[rn]?|Große[rn]?)\ (?:de[rmn]\ )?)?{_CAP}(?:\ {_CAP})?\ \d{{1,4}}\ ?[a-z]?,\ (?:D-)?\d{{5}}\ {_CAP}(?:\ (?:am|an\ der|im|in\ der|bei|ob\ der|vor\ der)\ {_CAP})?
    | (?:[가-힣]{{2,}}(?:시|도)\ )?(?:[가-힣]+(?:시|군|구)\ )?(?:[가-힣]+(?:읍|면)\ )?[가-힣]+\d*(?:대로|로|길)\ (?:\d+번길\ )?\d+(?:-\d+)?(?![\d:.])(?:,?\ \d+동)?(?:,?\ \d+층)?(?:,?\ \d+호)?
    | \d{{1,4}}(?:\ (?:bis|ter))?,?\ (?:rue|avenue|boulevard|place|quai|impasse|allée|chemin|route|cours)\ {_OF}{_TOWN_WORD}(?:[\ -]{_TOWN_WORD}){{0,2}}{_CITY}
    | (?:Calle|C/|Avenida|Avda\.|Plaza|Paseo|Rua|Via|Viale|Piazza|Corso|Vicolo)\ {_OF}{_TOWN_WORD}(?:\ {_TOWN_WORD}){{0,2}},?\ (?:n\.?º?\ ?)?\d{{1,4}}\b{_CITY}
    | P\.?\ ?O\.?\ Box\ \d+(?:,\ {_TOWN_WORD}(?:\ {_TOWN_WORD})?)?(?:,?\ (?:[A-Z]{{2}}\ )?\d{{5}}(?:-\d{{4}})?)? | Postfach\ \d[\d ]*\d(?:,\ \d{{5}}\ {_TOWN_WORD})?
    | (?:〒\d{{3}}-\d{{4}}\ ?)?(?:東京都|北海道|(?:大阪|京都)府|[一-龥]{{2,3}}県)[一-龥ぁ-んァ-ヶー]{{1,12}}[市区町村郡][一-龥ぁ-んァ-ヶー]{{0,12}}\ ?\d+(?:(?:丁目|番地?|号|[-−])\d*)*
    )""",
    re.X,
)

# ---- names

# fixed values: the hundred most frequent given names of the last hundred years, of the national statistics of a country that publishes them in the public domain (US Social Security Administration)
GIVEN = frozenset(
    """James Michael Robert John David William Richard Joseph Thomas Christopher Charles Daniel Matthew Anthony Mark Donald Steven Andrew Paul Joshua Kenneth Kevin Brian Timothy Ronald
    Jason George Edward Jeffrey Ryan Jacob Nicholas Gary Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Frank Raymond Jack Dennis Jerry
    Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Sarah Lisa Nancy Sandra Betty Ashley Emily Kimberly Margaret Donna Michelle Carol Amanda Melissa Deborah Stephanie
    Rebecca Sharon Laura Cynthia Dorothy Amy Kathleen Angela Shirley Emma Brenda Pamela Nicole Anna Samantha Katherine Christine Debra Rachel Carolyn Janet Maria Olivia Heather Helen""".split()
)
# fixed values: capitalised words that are no part of a name: at the start of sentences, days and months, parts of software and organisations
NO_NAME = frozenset(
    """The A An This That These Those It Its He She They We You I If In On At As By For From Of To With Before After Until Since When While Where Why How What Who Which And Or But So Then Not No Yes Is Was Are Were Be
    Do Did Does Has Have Had Will Would Can Could Should May Might Must Let Please See Use Run Open Note Also All Any Each Every Both More Most Some One Two Three First Last Next New Old Same Other Only Still Here There
    Der Die Das Den Dem Des Ein Eine Einen Und Oder Aber Wenn Weil Auf Ab Im Am Bei Mit Von Zum Zur Nach Vor Seit Wir Sie Ich Er Es Ist Nicht El La Los Las Un Una En Con Por Para Que Se No Final Session
    Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December
    Call Calling Owner Index Gate Queue Service Server Module Table Page Test Build Cache Client Worker Team Project Group Street Road Avenue Inc Ltd""".split()
)
_TITLE = r"(?:Dr|Mr|Mrs|Ms|Mx|Prof|Herr|Frau|Sra|Sr|Srta|Mme|Mlle|Don|Doña|Doctor|Professor|Señor|Señora|Monsieur|Madame|Sir|Miss)"
_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞĆČĎĐĘĚĞİŁŃŇŐŘŚŞŠŤŮŰŹŻŽ", "a-zß-öø-ÿ\u0101-\u017f"
# no capital inside: that is how components are written
_WORD = rf"(?:[ODL]['’]|Mc|Mac(?=[A-Z]))?[{_UPPER}][{_LOWER}]+"
_SURNAME = rf"{_WORD}(?:-{_WORD})?"
_PARTICLE = r"(?:(?:van|von|de|del|der|den|da|di|dos|bin|ibn|al|el|la|le|ter|ten|zu|Van|Von|De|Del|Der|Da|Di|Bin|Al|El) )"
_END = r"(?![A-Za-z0-9_])(?!-[A-Za-z])(?![./]\w)"
TITLED = re.compile(rf"(?<![A-Za-z0-9_.-]){_TITLE}(?:\. ?| )(?:{_TITLE}(?:\. ?| ))?(?:(?P<given>{_WORD}) (?:[A-Z]\. )?)?(?P<last>{_PARTICLE}{{0,2}}{_SURNAME}){_END}")
FULL = re.compile(rf"(?<![A-Za-z0-9_./-])(?P<given>{_WORD})(?:-{_WORD})? (?:[A-Z]\. ){{0,2}}{_PARTICLE}{{0,2}}(?P<last>{_SURNAME}){_END}")
# what stands before a person: labels, verbs of contact, prepositions of people, greetings, signatures
_ROLE = r"owner|reviewer|contact|escalate_to|author|assignee|maintainer|user|name|attendee|participant|manager|lead|colleague|customer|patient|engineer|host|speaker|employee|applicant|sender|recipient|signed|ansprechpartner(?:in)?|kolleg(?:e|in)|bearbeiter(?:in)?|verantwortlich"
BEFORE = re.compile(
    rf"(?:\b(?:signed-off-by|reviewed-by|co-authored-by|reported-by|acked-by|tested-by|cc|bcc|attn|from|to|by|sincerely|regards|wishes|cheers|thanks|greetings|gruß|grüße|grüßen|saludos|(?:{_ROLE})s?)[\"']?\s*[:=,]\s*[\"']?"
    rf"|\b(?:{_ROLE}|named|called|reported by|written by|reviewed by|approved by|signed by|led by|questions go to|ask(?:ed)? for|ask(?:ed)?|tell|told|met(?: with)?|meet(?:ing)?(?: with)?|call(?:ed)?|email(?:ed)?|mail(?:ed)?|phone[sd]?|contacted|thank|thanks(?: to)?|invite[sd]?|"
    r"sp(?:oke|eak) (?:to|with)|talk(?:ed)? (?:to|with)|work(?:ed|ing)? with|paired with|pair with|wrote to|reach(?:ed)?(?: out to)?|assigned to|handed(?: over)? to|deliver(?:ed)? to|sent to|escalate[sd]? to|forwarded to|hi|hello|dear|hey|"
    r"hallo|liebe[rs]?|geht an|gesprochen mit|sprach mit|telefoniert mit|ansprechpartner(?:in)? ist|wenden sie sich an|an frau|an herrn|hola|querid[oa]|estimad[oa]|hablé con|habló con|contacte con|contactar a|bonjour|cher|chère|contactez|"
    r"is|am|bin|soy|(?:raised|filed|sent|opened|closed|made|done|given|owned|run|requested|prepared|merged|tested|checked|fixed|maintained) by) "
    r"|(?:^|\n)[ \t>]*(?:--|—|–)[ ]|(?:검토자|담당자|작성자|요청자|보고자): ?|담당자는 )$",
    re.I,
)
# of these the ones that stand before anything: they count in small letters only
WEAK_BEFORE = re.compile(r"(?:is|by|am|soy|bin|lead|name|user) ", re.I)
AFTER = re.compile(
    r"^(?: ?<[^<>\s]+@| ?(?:님|씨)|(?:(?:,| 와| 과) \S+(?: \S+){0,2})? 두 사람| ?\(?(?:he/him|she/her|they/them)|(?:'s|’s) (?:laptop|desk|phone|number|email|mail|calendar|team|address|account|badge|office|report|manager|name|review|machine|house|home)\b"
    r"| (?:signed|asked|said|says|wrote|writes|paired|joined|replied|confirmed|approved|reviewed|reported|mentioned|explained|requested|agreed|suggested|noted|thinks|told|met|visited|lives|called|emailed|promised|complained|resigned|offered|"
    r"(?:is|was) (?:out|away|on leave|on call|sick|responsible|the (?:owner|reviewer|author|contact))|can be reached|will (?:review|call|join|send|take|be)|has (?:left|asked|agreed|approved|moved)|wants|knows|owns|leads|"
    r"sagte|schrieb|bat|fragte|meldete|bestätigte|wohnt|ist (?:krank|abwesend|zuständig)|dijo|escribió|preguntó|pidió|vive|a dit|a écrit|habite)\b)"
)
_JOINED = re.compile(rf"^(?: (?:and|und|y|et|&) |, )(?P<next>(?:{_TITLE}\.? )?(?:{_WORD} )?(?:[A-Z]\. )?{_PARTICLE}{{0,2}}{_SURNAME}){_END}")
_CELL = re.compile(r"\|[ ]*$")
_DETAIL = re.compile(r"^[ ]?[,;:|(]?[ ]?(?:(?:Telefon|phone|tel|mobile|mail|email|e-mail|연락처)\.?:? )?\(?$", re.I)

_FAMILY = "김이박최정강조윤장임한오서신권황안송류홍유전고문양손배백허남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용"
_PERSON = r"(?:님|씨|선생님?|교수님?|박사님?|과장님?|대리님?|부장님?|팀장님?|차장님?|사원|주임|매니저)"
KOREAN = re.compile(
    rf"(?<![가-힣])(?:(?P<a>[{_FAMILY}][가-힣]{{1,2}})(?= ?{_PERSON}(?![가-힣]{{2}}))|(?P<b>[{_FAMILY}][가-힣]{{2}})(?=(?:, | 와 | 과 )\S+(?: \S+){{0,2}} 두 사람)|(?P<c>[{_FAMILY}][가-힣]{{2}})(?= 두 사람)"
    rf"|(?P<d>[{_FAMILY}][가-힣]{{2}})(?=(?:에게|께|한테)(?:서)? ?(?:\S+ )?(?:물|연락|전화|문의|알리|알려|보내|보냈|전달|전했|부탁|요청|확인|맡))"
    rf"|(?P<e>[{_FAMILY}][가-힣]{{2}})(?=(?:가|이|은|는|께서)? (?:\S+ ){{0,2}}(?:말했|말하|말씀|전했|물었|답했|대답|제안했|부탁했|알렸|승인했|서명했))"
    rf"|(?P<f>[{_FAMILY}][가-힣]{{2}})(?= ?\((?:\+82|0\d|[\w.+-]+@)))"
)
KOREAN_LABELLED = re.compile(
    rf"(?:(?:검토자|담당자|작성자|요청자|보고자|이름|성명|고객|환자|수신|발신): ?|(?:owner|reviewer|contact|escalate_to|author|user|name)[\"']?\s*[:=]\s*[\"']?)([{_FAMILY}][가-힣]{{2}})(?![가-힣])"
)


def _emails(t: str) -> Iterator[tuple[int, int]]:
    for m in EMAIL.finditer(t):
        spoken = " at " in m.group(2).lower()
        if spoken and not re.search(r"dot", m.group(3), re.I):
            continue
        if m.group(1).lower() == "git" or (t[m.end() : m.end() + 1] == ":" and t[m.end() + 1 : m.end() + 2].isalnum()) or _LOGIN.search(t[max(0, m.start() - 40) : m.start()]):
            continue
        yield m.span()


def _id_numbers(t: str) -> Iterator[tuple[int, int]]:
    for m in ID_NUMBER.finditer(t):
        if m.lastgroup == "passport" and not re.search(r"(?i)(?:pass|ausweis|여권|no\.?|id|nummer)\W{0,3}$", t[max(0, m.start() - 16) : m.start()]) and m.group()[0] != "X":
            continue
        yield m.span()
    for m in LABELLED.finditer(t):
        yield m.span("number")


def _phones(t: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(t):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()
    for m in CALLED.finditer(t):
        if 7 <= sum(c.isdigit() for c in m.group("number")) <= 15:
            yield m.span("number")


def _addresses(t: str) -> Iterator[tuple[int, int]]:
    for m in ADDRESS.finditer(t):
        end = m.end()
        # "..., Lena Vogt": a town that a verb of people follows is a person
        if m.group("town") and end == m.end("town") and (m.group("town").split()[0] in GIVEN or AFTER.match(t[end : end + 40])):
            end = m.start("town") - 2
        yield m.start(), end


def _is_person(t: str, m: re.Match, taken: "Taken", last: int) -> bool:
    """Whether two capitalised words are a person; last: where the name before ends."""
    given, surname = m.group("given"), m.group("last")
    if given in NO_NAME or (surname.split("-")[0] in NO_NAME and m.group().count(" ") == 1):
        return False
    if given in GIVEN:
        return True
    before, after = t[max(0, m.start() - 60) : m.start()], t[m.end() : m.end() + 90]
    if AFTER.match(after):
        return True
    # in a heading, where every word is a capital one, "By Rank Fusion" is nobody
    if (at := BEFORE.search(before)) and (at.group()[:1].islower() or not WEAK_BEFORE.fullmatch(at.group())):
        return True
    if 0 <= last <= m.start() and re.fullmatch(r" (?:and|und|y|et|&) |, (?:and )?", t[last : m.start()]):
        return True
    if (j := _JOINED.match(after)) and AFTER.match(after[j.end() :]) and not set(j.group("next").split()) & NO_NAME:
        return True
    if _CELL.search(before) and re.match(r"[ ]*\|", after):
        return True
    # contact details beside it
    start = taken.after(m.end())
    return start is not None and start - m.end() <= 24 and bool(_DETAIL.match(t[m.end() : start]))


def _names(t: str, taken: "Taken") -> Iterator[tuple[int, int]]:
    for m in TITLED.finditer(t):
        # "Ms. Sindel Later we ...": a second word belongs to the name where no sentence goes on with it
        rest = t[m.end() : m.end() + 40]
        ahead = m.group("given") and m.group("given") not in GIVEN and (m.group("last") in NO_NAME or re.match(rf":| [{_UPPER}]| (?:we|the|it|they|this|that|there|a|an|is|was|were|are|has|had|der|die|das|wir|ist|war) ", rest) and not AFTER.match(rest))
        yield m.start(), m.end("given") if ahead else m.end()
    m, last = FULL.search(t), -1
    while m:
        if _is_person(t, m, taken, last):
            last = m.end()
            yield m.span()
            m = FULL.search(t, m.end())
        else:  # the second word may be the given name of the next two
            m = FULL.search(t, m.end("given"))
    if not t.isascii():
        for m in KOREAN.finditer(t):
            yield m.span()
        for m in KOREAN_LABELLED.finditer(t):
            yield m.span(1)


# what a text must hold for a kind to be looked for: all that the patterns accept holds one of these. Names have no such words
_HINTS = {
    "address": (
        *(f" {w}" for w in ("Street", "Avenue", "Road", "Lane", "Drive", "Court", "Boulevard", "Place", "Square", "Terrace", "Way", "Close", "Crescent", "Row", "Hill", "Parkway")),
        *(f" {w}" for w in ("St", "Ave", "Rd", "Ln", "Dr", "Ct", "Blvd", "Pl", "Sq", "Pkwy")),
        "traße", "tr. ", "gasse", "Gasse", "weg ", "Weg ", "allee", "Allee", "platz", "Platz", "ring ", "ufer ", "damm ", "로 ", "길 ",
        *(f" {w} " for w in ("rue", "avenue", "boulevard", "place", "quai", "impasse", "allée", "chemin", "route", "cours")),
        *(f"{w} " for w in ("Calle", "C/", "Avenida", "Avda.", "Plaza", "Paseo", "Rua", "Via", "Viale", "Piazza", "Corso", "Vicolo", "Postfach", "Box")),
        "東京都", "北海道", "府", "県",
    ),
}
# of patterns that ignore case, in lower case
_LOW_HINTS = {"email": ("@", "[at]", "(at)"), "at": (" at ",), "dot": ("dot",)}
_TOWN = re.compile(r", (?:D-)?\d{5} ")
_DIGITS = re.compile(r"\d[\d ().+/-]{4,}[\dA-Z]")


@lru_cache(maxsize=2)
def _hints(low: bool) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (_LOW_HINTS if low else _HINTS).items():
        for w in words:
            a.add_word(w, kind)
    a.make_automaton()
    return a


def _worth(t: str) -> set[str]:
    """The kinds that a text may hold."""
    # as patterns that ignore case take them
    low = t.replace("\u0130", "i").lower().replace("\u0131", "i").replace("\u017f", "s")
    worth = {"name"} | {kind for _, kind in _hints(False).iter(t)} | {kind for _, kind in _hints(True).iter(low)}
    if "at" in worth and "dot" in worth:
        worth.add("email")
    if "address" not in worth and _TOWN.search(t):
        worth.add("address")
    if _DIGITS.search(t):
        worth |= {"id_number", "phone"}
    return worth


class Taken:
    """The mentions of a text so far, in order; none overlap."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, str]] = []

    def add(self, a: int, b: int, kind: str) -> None:
        k = bisect_left(self.spans, (a,))
        if (k and self.spans[k - 1][1] > a) or (k < len(self.spans) and self.spans[k][0] < b):
            return
        insort(self.spans, (a, b, kind))

    def after(self, at: int) -> int | None:
        """Where the next mention begins."""
        k = bisect_left(self.spans, (at,))
        return self.spans[k][0] if k < len(self.spans) else None


_FINDERS = (("email", _emails), ("id_number", _id_numbers), ("address", _addresses), ("phone", _phones))


def mentions(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each mention, in order, none overlapping."""
    if not text or not text.strip():
        return []
    t = text.translate(_PLAIN)
    taken, worth = Taken(), _worth(t)
    for kind, find in _FINDERS:
        if kind in worth:
            for a, b in find(t):
                taken.add(a, b, kind)
    if "name" in worth:
        # what stands beside a name is looked up among the others, so names are added last
        for a, b in list(_names(t, taken)):
            taken.add(a, b, "name")
    return taken.spans


# ---- pseudonyms


def _prf(key: bytes, tweak: str, round_no: int, half: int, size: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{round_no}|{half}|{size}".encode(), key=key, digest_size=16).digest(), "big")


def permute(value: int, size: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """A keyed permutation of range(size): an unbalanced Feistel network over two factors whose product is at least size, walked until the value is in range."""
    if size < 2:
        return value
    a = 1
    while a * a < size:
        a += 1
    b = -(-size // a)
    rounds = range(ROUNDS)
    while True:
        left, right = divmod(value, b)
        for r in reversed(rounds) if undo else rounds:
            if r % 2:
                f = _prf(key, tweak, r, left, b)
                right = (right - f if undo else right + f) % b
            else:
                f = _prf(key, tweak, r, right, a)
                left = (left - f if undo else left + f) % a
        value = left * b + right
        if value < size:
            return value


def _permute_digits(digits: str, key: bytes, tweak: str, undo: bool = False) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, f"{tweak}|{len(digits)}", undo)).zfill(len(digits)) if digits else digits


_EPOCH = datetime.date(1900, 1, 1)
_DAYS = (datetime.date(2000, 1, 1) - _EPOCH).days


def _permute_date(six: str, key: bytes, tweak: str, undo: bool = False) -> str:
    """YYMMDD to another valid YYMMDD; what is no date is permuted as digits among what is no date."""
    day = _day(six)
    if day is not None:
        return (_EPOCH + datetime.timedelta(days=permute(day, _DAYS, key, tweak + "|date", undo))).strftime("%y%m%d")
    while True:
        six = _permute_digits(six, key, tweak + "|nodate", undo)
        if _day(six) is None:
            return six


def _day(six: str) -> int | None:
    try:
        return (datetime.date(1900 + int(six[:2]), int(six[2:4]), int(six[4:])) - _EPOCH).days
    except ValueError:
        return None


def _lay(template: str, digits: str) -> str:
    """The template with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in template)


# fixed values: the letters of a Spanish number by its remainder of 23, the weights of a Korean resident number's check digit
_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)


def _resident_check(twelve: str) -> str:
    return str((11 - sum(int(d) * w for d, w in zip(twelve, _WEIGHTS)) % 11) % 10)


def _resident(digits: str, key: bytes, undo: bool) -> str:
    """Date, century and sex, serial, check digit: the date becomes a date, the century and sex stay, a right check digit is recomputed and a wrong one stays wrong."""
    date, sex, right = _permute_date(digits[:6], key, "rrn", undo), digits[6], _resident_check(digits[:12]) == digits[12]
    if right:
        twelve = date + sex + _permute_digits(digits[7:12], key, "rrn5", undo)
        return twelve + _resident_check(twelve)
    # how far the digit is from the right one is kept; the tail is permuted by itself
    off = (int(digits[12]) - int(_resident_check(digits[:12]))) % 10
    twelve = date + sex + _permute_digits(digits[7:12], key, "rrn5", undo)
    return twelve + str((int(_resident_check(twelve)) + off) % 10)


def pseudonym(kind: str, value: str, key: bytes, undo: bool = False) -> str:
    """Numbers permuted within their format (undo takes them back), other values as a keyed digest of their plain form."""
    plain = value.translate(_PLAIN)
    digits = "".join(c for c in plain if c.isdigit())
    if kind == "phone":
        return _lay(plain, digits[:-7] + _permute_digits(digits[-7:], key, "phone", undo))
    if kind == "id_number":
        if re.fullmatch(r"\d{6} ?- ?\d{7}", plain):
            return _lay(plain, _resident(digits, key, undo))
        new = _permute_digits(digits, key, "id", undo)
        if re.fullmatch(r"\d{8}-?[A-Z]", plain):
            # the letter keeps its distance from the right one: none for a right letter
            off = _LETTERS.find(plain[-1]) - int(digits) % 23
            return _lay(plain[:-1], new) + _LETTERS[(int(new) + off) % 23] if plain[-1] in _LETTERS else _lay(plain, new)
        return _lay(plain, new)
    if kind == "email":
        plain = re.sub(r"[ ]?[\[(]?\bdot\b[\])]?[ ]?", ".", re.sub(r"[ ]?[\[(]?\bat\b[\])]?[ ]?", "@", plain, flags=re.I), flags=re.I)
    plain = " ".join(plain.casefold().split())
    return hashlib.blake2b(f"{kind}|{plain}".encode(), key=key, digest_size=16).hexdigest()


def replaced(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, str]]]:
    """The text with ``[TYPE pseudonym]`` in place of each mention, and (kind, pseudonym) of each."""
    found = mentions(text)
    if not found:
        return text, []
    out, at, names = [], 0, []
    for a, b, kind in found:
        names.append((kind, pseudonym(kind, text[a:b], key)))
        out += [text[at:a], f"[{kind.upper()} {names[-1][1]}]"]
        at = b
    return "".join([*out, text[at:]]), names


def redact(text: str | None, key: bytes) -> str | None:
    return replaced(text, key)[0]


# ---- over tables


def texts(memories: DataFrame, sessions: DataFrame) -> DataFrame:
    """(src_table, row_no, text) of both tables."""
    a = memories.select(F.lit("memories").alias("src_table"), F.col("line_no").cast("long").alias("row_no"), F.col("content").alias("text"))
    b = sessions.select(F.lit("sessions").alias("src_table"), F.col("session_no").cast("long").alias("row_no"), F.col("session").alias("text"))
    return a.unionByName(b)


@lru_cache(maxsize=8)
def _key(secret: str) -> bytes:
    return hashlib.blake2b(secret.encode(), digest_size=32).digest()


def _checked(secret: str) -> str:
    if not secret:
        raise ValueError("pseudonyms need a secret: set spark.lorebase.pii.secret")
    return secret


def linked(rows: DataFrame, secret: str) -> DataFrame:
    """(src_table, row_no, pii_kind, mention_no, pseudonym): one row per mention, with what stands for it in the redacted text."""
    secret = _checked(secret)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = _key(secret)
        for b in batches:
            row, kinds, numbers, names = [], [], [], []
            for n, text in enumerate(b.column(2).to_pylist()):
                seen: dict[str, int] = {}
                for kind, name in replaced(text, key)[1]:
                    seen[kind] = seen.get(kind, 0) + 1
                    row.append(n)
                    kinds.append(kind)
                    numbers.append(seen[kind])
                    names.append(name)
            at = pa.array(row, pa.int64())
            cells = [b.column(0).take(at), b.column(1).take(at), pa.array(kinds, pa.string()), pa.array(numbers, pa.int64()), pa.array(names, pa.string())]
            yield pa.RecordBatch.from_arrays(cells, ["src_table", "row_no", "pii_kind", "mention_no", "pseudonym"])

    return rows.select("src_table", "row_no", "text").mapInArrow(run, "src_table string, row_no long, pii_kind string, mention_no long, pseudonym string")


def redacted(rows: DataFrame, secret: str) -> DataFrame:
    """(src_table, row_no, text) with placeholders; ``secret`` keys the pseudonyms."""
    secret = _checked(secret)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = _key(secret)
        for b in batches:
            texts = pa.array([redact(t, key) for t in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], ["src_table", "row_no", "text"])

    return rows.select("src_table", "row_no", "text").mapInArrow(run, "src_table string, row_no long, text string")
