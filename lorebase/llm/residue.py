"""Template residue, filler, error pages and script notices.

Code (fences, indented fences, inline code) is blanked out. One automaton, whose words carry their types, finds the openers of slots and the phrases and words below in what is left; a text
without a hit is clean. Coverage is judged twice: against the length of each segment with hits (a line, else its sentences), so that a long real text with one such segment
is found as well as a short one that is nothing else, and against the length of the document, so that phrases strewn over many segments count together. An unfilled slot counts
wherever it stands outside code. A real sentence that speaks about such things is covered in part only. The same rules hold at every length.

Defined results: null, empty and blank texts are clean; the length of a text does not matter; extra columns are ignored; a null ``doc_id`` stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("slot", "filler", "error_page", "script_notice")

# fixed values: phrases of error pages
ERROR_PHRASES = (
    "bad request", "unauthorized", "payment required", "forbidden", "not found", "method not allowed", "request timeout", "gone", "too many requests",
    "internal server error", "bad gateway", "service unavailable", "gateway timeout", "http error", "error", "http",
    "try again in", "try again later", "please try again", "seconds", "minutes", "hours", "status", "title",
    "page not found", "that page does not exist", "oops", "it may have moved or been removed", "this page isn't available",
    "the page you are looking for", "the page you requested", "could not be found", "cannot be found",
    "this site can't be reached", "took too long to answer", "took too long to respond", "refused to connect", "err_connection",
    "sorry", "something went wrong", "on our side", "the team was told", "an error occurred", "an unexpected error occurred",
    "we're down for maintenance", "down for maintenance", "we will be back shortly", "be back soon", "under maintenance",
    "upstream connect failure or reset before headers", "upstream connect error", "cause: connection timeout", "disconnect/reset before headers",
    "the upstream closed the connection before it sent a reply", "upstream request timeout",
    "application error", "a server-side problem has occurred", "a client-side exception has occurred", "digest",
    "the server at", "could not finish this request", "reference", "certificate for", "has expired", "connection closed", "connection reset",
    "access to", "access denied", "was denied", "your request was blocked by a security rule", "request blocked", "ray",
    "you do not have permission to view this document", "you don't have permission to access", "request access from its owner",
    "quota used up for this address", "quota exceeded", "come back in", "whitelabel fallback", "whitelabel error page", "no mapping for", "no explicit mapping for",
    "the page could not be rendered", "incident", "traceback", "templaterendererror at", "err", "backend=none", "backend fetch failed", "retries",
    "nothing here", "the link you followed is broken or too old", "the link you followed may be broken",
    "your session has ended", "your session has expired", "please sign in again to see this page", "please log in again",
    "if this keeps happening, tell the site owner", "contact the administrator", "back to start page",
    "die seite ist zurzeit nicht erreichbar", "seite nicht gefunden", "die seite wurde nicht gefunden", "fehler", "zugriff verweigert", "vorgang",
    "bitte versuchen sie es später erneut", "interner serverfehler", "ihre sitzung ist abgelaufen",
    "la página no está disponible en este momento", "página no encontrada", "no se encontró la página", "acceso denegado", "error interno del servidor",
    "inténtelo de nuevo más tarde", "tu sesión caducó", "inicia sesión otra vez",
    "페이지를 찾을 수 없습니다", "주소를 다시 확인해 주세요", "오류", "서비스 점검 중입니다", "시간 뒤에 다시 접속해 주세요", "잠시 후 다시 시도해 주세요", "접근이 거부되었습니다",
    "서버 오류가 발생했습니다", "세션이 만료되었습니다",
    "サーバーエラーが発生しました", "しばらくしてから再度お試しください", "ページが見つかりません", "アクセスが拒否されました", "ただいまメンテナンス中です",
)

# fixed values: stock texts of common servers, and of error pages in other languages
SERVER_PHRASES = (
    "the requested url was not found on this server", "the requested resource could not be found", "the resource you are looking for has been removed", "had its name changed, or is temporarily unavailable",
    "service temporarily unavailable", "the server is temporarily unable to service your request", "due to maintenance downtime or capacity problems", "please try again later", "additionally, a", "error was encountered while trying to use an errordocument to handle the request",
    "the server encountered an internal error or misconfiguration and was unable to complete your request", "internal error", "the page you were looking for doesn't exist", "you may have mistyped the address or the page may have moved",
    "we're sorry, but something went wrong", "server error in", "runtime error", "temporarily unavailable", "the proxy server received an invalid response from an upstream server", "web server is down", "the origin web server",
    "error establishing a database connection", "there has been a critical error on this website", "you have been blocked", "you are unable to access", "why have i been blocked", "this page isn't working", "didn't send any data",
    "404 not found", "403 forbidden", "nginx", "apache", "origin dns error", "page cannot be displayed", "the site is under construction", "this domain is for sale", "this website is currently unavailable", "http status",
    "page non trouvée", "page introuvable", "la page que vous recherchez n'existe pas", "la page demandée est introuvable", "la page demandée n'existe pas", "accès refusé", "accès interdit", "erreur interne du serveur", "une erreur est survenue", "une erreur s'est produite",
    "veuillez réessayer plus tard", "service indisponible", "service temporairement indisponible", "votre session a expiré", "erreur",
    "страница не найдена", "запрашиваемая страница не найдена", "такой страницы не существует", "доступ запрещён", "доступ запрещен", "внутренняя ошибка сервера", "произошла ошибка", "попробуйте позже", "попробуйте ещё раз позже", "повторите попытку позже",
    "сервис временно недоступен", "сайт временно недоступен", "ошибка",
    "页面不存在", "找不到页面", "页面未找到", "您访问的页面不存在", "您访问的页面未找到", "抱歉", "服务器内部错误", "内部服务器错误", "服务器错误", "访问被拒绝", "禁止访问", "请稍后再试", "服务暂时不可用", "系统繁忙", "网页无法访问", "错误",
    "página não encontrada", "acesso negado", "erro interno do servidor", "tente novamente mais tarde", "pagina non trovata", "accesso negato", "errore interno del server", "riprova più tardi", "pagina niet gevonden", "toegang geweigerd",
)

#: Of the phrases above, those that say nothing by themselves: they add to the coverage of a segment that has another.
WEAK = frozenset(
    "error http seconds minutes hours status title gone sorry oops digest reference ray incident traceback err retries fehler vorgang 오류 forbidden unauthorized".split()
) | {"has expired", "access to", "was denied", "try again in", "come back in", "the server at", "certificate for", "connection closed", "on our side", "not found", "backend=none", "back to start page", "please try again later", "additionally, a", "internal error", "nginx", "apache", "http status", "runtime error", "temporarily unavailable", "the origin web server", "erreur", "ошибка", "错误", "抱歉", "you are unable to access"}

# fixed values: notices that scripts are required
SCRIPT_PHRASES = (
    "please turn on javascript in your browser", "please enable javascript", "to use this page", "to continue", "to view this page", "to run this app",
    "you must enable scripts and cookies to continue", "you need to enable javascript to run this app", "enable javascript and cookies to continue",
    "your browser does not run scripts", "your browser does not support javascript", "so nothing can be shown here",
    "javascript is disabled", "javascript is required", "javascript must be enabled", "some parts of this site will not work",
    "this app needs javascript", "this site requires javascript", "this page requires javascript", "enable it and reload",
    "noscript", "loading failed", "this viewer requires javascript to run", "requires javascript to run",
    "just a moment", "verifying your browser before the page opens", "checking your browser before accessing", "verify you are human",
    "checking that you are not a robot", "this takes a few seconds", "scripts must be allowed",
    "bitte aktivieren sie javascript", "um diese seite zu sehen", "um fortzufahren", "diese seite benötigt javascript",
    "active javascript para ver esta página", "activa javascript", "habilite javascript", "para ver esta página", "para continuar",
    "이 페이지를 보려면 자바스크립트를 켜야 합니다", "자바스크립트를 활성화", "자바스크립트를 켜 주세요", "자바스크립트가 필요합니다",
    "このページを表示するにはjavascriptを有効にしてください", "javascriptを有効にしてください", "javascriptが無効になっています",
)
WEAK_SCRIPT = frozenset({"to use this page", "to continue", "to view this page", "to run this app", "noscript", "loading failed", "this takes a few seconds", "um diese seite zu sehen", "um fortzufahren", "para ver esta página", "para continuar", "just a moment", "enable it and reload"})

# fixed values: more of the same, in other wordings and languages
SCRIPT_WORDINGS = (
    "please enable js and disable any ad blocker", "javascript seems to be disabled in your browser", "for the best experience on our site", "be sure to turn on javascript in your browser", "we're sorry but this app doesn't work properly without javascript enabled", "please enable it to continue",
    "your browser has javascript disabled", "javascript is not enabled", "javascript is turned off", "turn on javascript", "enable javascript in your browser", "please activate javascript", "please allow cookies", "this site uses javascript", "works best with javascript enabled", "this page needs javascript",
    "javascript is not available", "we've detected that javascript is disabled in this browser", "please switch to a supported browser", "this content requires javascript", "to display this page", "and reload the page", "needs to review the security of your connection before proceeding",
    "veuillez activer javascript", "activez javascript", "javascript est désactivé", "javascript doit être activé", "pour afficher cette page", "pour continuer", "cette page nécessite javascript", "votre navigateur ne prend pas en charge javascript", "dans votre navigateur",
    "включите javascript", "пожалуйста, включите javascript", "для работы сайта необходимо включить javascript", "javascript отключён", "javascript отключен", "необходим javascript", "в вашем браузере", "в настройках браузера", "чтобы продолжить",
    "请启用javascript", "请开启javascript", "您的浏览器不支持javascript", "需要启用javascript", "您需要启用javascript", "请在浏览器中启用javascript", "才能运行此应用", "以查看此页面", "以继续",
    "bitte schalten sie javascript ein", "javascript ist deaktiviert", "in ihrem browser", "javascript está desactivado", "en su navegador", "por favor, ative o javascript", "para continuar", "abilita javascript", "per continuare", "자바스크립트가 비활성화되어 있습니다",
)
WEAK_WORDINGS = frozenset({"for the best experience on our site", "please enable it to continue", "please allow cookies", "to display this page", "and reload the page", "pour afficher cette page", "pour continuer", "dans votre navigateur", "в вашем браузере", "в настройках браузера", "чтобы продолжить", "才能运行此应用", "以查看此页面", "以继续", "in ihrem browser", "en su navegador", "per continuare"})

# fixed values: sentences that stand where text belongs
FILLER_PHRASES = (
    "placeholder paragraph", "placeholder text", "sample text", "dummy text", "text text text", "filler text", "blindtext", "your text here", "insert text here", "text goes here",
    "this section will be written later", "content coming soon", "coming soon", "to be added", "to be written", "to be determined", "to be completed",
    "describe the change in two or three sentences", "add a description here", "write a short summary here",
    "hier steht später der text", "hier kommt der text", "beispieltext", "platzhaltertext", "wird noch ergänzt",
    "aquí va el texto", "texto de ejemplo", "texto de relleno", "próximamente",
    "여기에 내용을 입력하세요", "내용을 입력하세요", "예시 문장입니다", "추후 작성 예정", "샘플 텍스트",
    "le texte viendra ici", "texte à venir", "texte d'exemple", "здесь будет текст", "пример текста", "текст появится позже", "此处填写内容", "在此输入内容", "示例文本", "内容待补充", "texto de exemplo", "testo di esempio",
    "ここに本文を入力", "ここにテキストを入力", "サンプルテキスト", "ダミーテキスト", "準備中です",
)
WEAK_FILLER = frozenset({"coming soon"})

# fixed values: words that filler is made of
LATIN_WORDS = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud
    exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint
    occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum porta felis lectus arcu massa vitae orci nunc sedum vivamus mauris
    vestibulum pellentesque maecenas integer donec praesent suspendisse curabitur aenean nullam phasellus""".split()
)
MASH_WORDS = frozenset("foo bar baz qux quux asdf asdfg qwer qwerty zxcv hjkl blah xxx yyy test abc aaa jkl".split())

# fixed values: names that slots are filled with
_FIELD = (
    r"(?:project|user|first|last|full|company|customer|client|team|file|branch|release|ticket|title|owner|author|date|time|summary|description|next|your|name|email|id|version|key|value|"
    r"address|phone|city|subject|topic|url|link|content|text|body|message|step|steps|names?|number|amount|product|repo|repository|날짜|제목|이름|내용|요약|담당자|titel|datum|fecha|título|nombre|日付|名前|題名)"
)
_NAME = rf"(?:{_FIELD}(?:[ _-]?{_FIELD})*|(?:{_FIELD}[ _-]?)+)"
_ANY = f"(?i:{_NAME})"
_SLOTS = (
    r"\{\{[^{}\n]+\}\}", r"\{%[^{}\n]+%\}", r"<%[^<>\n]+%>", r"\$\{[^{}\n]+\}", rf"(?<![\w%\\/])%{_NAME.upper()}%(?![\w%])", rf"\[(?i:{_FIELD})(?:[ _-](?i:{_FIELD}))+\](?![(\[:])", rf"(?:(?<=Dear )|(?<=Hello )|(?<=Hi ))\[{_ANY}\]",
    rf"(?<![\w$])\${_ANY}\$(?!\w)", r"\{[a-z][\w ]{0,24}\}", r"\{\d{1,2}\}", r"%\([A-Za-z_]\w*\)[sdf]", r"##[A-Z][A-Z0-9_ ]{1,30}##", r"@@[A-Za-z]\w{0,30}@@", r"%%[A-Za-z]\w{1,30}%%",
    r"(?<!\w)__[A-Z][A-Z0-9_]{1,30}__(?!\w)", rf"\(\( {_ANY} \)\)", rf"\[\[ ?{_ANY} ?\]\]", rf"«{_ANY}»",
    r"\[(?i:insert|enter|add|type|choose|select|your)\b[^\[\]\n]+\]", r"\[[^\[\]\n]+\b(?i:goes here|here|einfügen|eingeben|einsetzen|aquí|insertar)\]", r"\[[^\[\]\n]+(?:입력|を入力|をここに)\]",
    rf"\[{_NAME.upper()}\]", rf"(?<![\w>])<(?:{_NAME.upper()})>(?!\w)", r"<(?i:your|insert|enter)\b[^<>\n]+>", rf"<!-- ?{_ANY} ?-->",
    r"(?<!\w)_{5,}(?!\w)", r"\[object Object\]", r"\bTODO:? (?i:fill in|add|insert|write)\b", r"(?<![\w/%-])YYYY-MM-DD(?![\w/-])", r"(?<![\w.'\"-])undefined(?![\w.'\"(-])",
)
SLOT = re.compile("|".join(f"(?:{s})" for s in _SLOTS))
# an upper-case pattern has no Hangul or Kana left to change, so one text serves both cases

#: What slots begin with, in lower case.
SLOT_HINTS = ("{", "[", "<", "$", "%", "##", "@@", "__", "((", "«", "todo", "yyyy-", "undefined")
#: Where a slot may begin: SLOT is tried there only.
_OPENER = re.compile(r"[{\[<$«]|%(?=[(A-Z%])|##(?=[A-Z])|@@(?=[A-Za-z])|__|\(\( |TODO|YYYY-|undefined")

_FENCE = re.compile(r"^[ \t>]*(```|~~~).*?(?:^[ \t>]*\1[^\n]*$|\Z)", re.S | re.M)
_INLINE = re.compile(r"(`+)(?!`)[^\n]+?(?<!`)\1(?!`)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_NOISE = re.compile(r"https?://\S+|\b[\w-]+(?:\.[\w-]+)+\b|/\S*|\b(?=\w*\d)\w+\b|[\W_]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_JSON_ERROR = re.compile(r'^\s*\{\s*"(?:error|errors|status|code|message)"\s*:.*\}\s*$')
_STATUS = re.compile(r"^\W*(?:http(?:/\d(?:\.\d)?)?[ :]*)?(?:error[ :]*)?[45]\d\d\b", re.I)
_HTML_STATUS = re.compile(r"<(?:title|h1)>\s*(?:error\s*)?[45]\d\d\b[^<]{0,60}</", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
COVER = 0.65
#: Different words of filler that a segment of them has at least.
DISTINCT = 3


_PHRASES = {
    "filler": (FILLER_PHRASES, WEAK_FILLER),
    "script_notice": (SCRIPT_PHRASES + SCRIPT_WORDINGS, WEAK_SCRIPT | WEAK_WORDINGS),
    "error_page": (ERROR_PHRASES + SERVER_PHRASES, WEAK),
}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """The one automaton. A hit is a tuple of what its word is: ("slot",), ("phrase", kind, length, strong), ("latin" or "mash", word); a tag may part a phrase, so "<" is a slot and a phrase of no kind.

    It holds all that the rules begin with, so that it never decides by itself.
    """
    types: dict[str, list[tuple]] = {"<": [("phrase", None, 1, False)]}
    for word in SLOT_HINTS:
        types.setdefault(word, []).append(("slot",))
    for kind, vocabulary in (("latin", LATIN_WORDS), ("mash", MASH_WORDS)):
        for word in vocabulary:
            types.setdefault(word, []).append((kind, word))
    for kind, (source, weak) in _PHRASES.items():
        for word in dict.fromkeys(source):
            types.setdefault(word, []).append(("phrase", kind, len(word), word not in weak))
    a = ahocorasick.Automaton()
    for word, values in types.items():
        a.add_word(word, tuple(values))
    a.make_automaton()
    return a


def blank_code(text: str) -> str:
    """The text with its code blanked out."""
    if "`" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
        text = _INLINE.sub(" ", text)
    return text


class Cover:
    """What phrases of one kind cover of a segment: which characters, whether one of them says something by itself, how long those are that do not."""

    def __init__(self, length: int):
        self.marked, self.strong, self.weak = bytearray(length), False, set()


def covers(segment: str) -> dict[str, Cover]:
    """The covers of all kinds, by one pass. Phrases stand at word boundaries, where the script has them."""
    out: dict[str, Cover] = {}
    for end, values in automaton().iter(segment):
        for value in values:
            if value[0] != "phrase" or value[1] is None:
                continue
            _, kind, n, strong = value
            start = end - n + 1
            before, after = segment[start - 1 : start], segment[end + 1 : end + 2]
            if (_in_script_of(before, segment[start])) or (_in_script_of(after, segment[end])):
                continue
            c = out.get(kind) or out.setdefault(kind, Cover(len(segment)))
            c.marked[start : end + 1] = b"\x01" * n
            c.strong |= strong
            if not strong:
                c.weak.add(n)
    return out


def _in_script_of(beside: str, edge: str) -> bool:
    """Whether a character goes on with the word at whose edge it stands: in scripts that set words apart."""
    return beside.isalnum() and edge.isalnum() and ord(beside) < 0x1100 and ord(edge) < 0x1100


def _share(segment: str, cover: Cover | None) -> tuple[float, bool, int]:
    """Share of the segment's letters that are covered, whether the phrases say something, and the letters covered.

    Numbers, addresses and codes are the variable parts of a notice and count neither way.
    """
    if cover is None:
        return 0.0, False, 0
    marked = cover.marked
    letters = covered = 0
    at = 0
    for m in [*_NOISE.finditer(segment), None]:
        upto = m.start() if m else len(segment)
        letters += upto - at
        covered += sum(marked[at:upto])
        if m:
            covered_noise = sum(marked[m.start() : m.end()])
            if covered_noise and any(ch.isalpha() for ch in m.group()):
                letters += covered_noise
                covered += covered_noise
            at = m.end()
    share = covered / max(1, letters)
    # two that say nothing by themselves say it together, where there is little else
    return share, cover.strong or (len(cover.weak) > 1 and share >= 0.8 and covered >= 12), covered


def _made_of(segment: str, vocabulary: frozenset, least: int) -> bool:
    tokens = re.findall(r"[^\W\d_]+", segment)
    if len(tokens) < least:
        return False
    hits = [t for t in tokens if t in vocabulary]
    return len(hits) >= 0.8 * len(tokens) and len(set(hits)) >= DISTINCT


def kinds_of(text: str | None) -> tuple[list[str], float]:
    """The kinds of residue in a text, and the share of its characters in residue segments (a slot counts its own)."""
    if not text or not text.strip():
        return [], 0.0
    # both passes read the same text
    plain = blank_code(text)
    low = plain.lower().replace("’", "'")
    found, covered, has_opener = [], 0, False
    # lower case may change the length of a text, so the lines that hold a hit are cut from the lowered one
    done = upto = 0
    words: dict[str, set[str]] = {"latin": set(), "mash": set()}
    reach: dict[str, int] = {}
    for end, values in automaton().iter(low):
        look = False
        for value in values:
            if value[0] == "slot":
                has_opener = True
            elif value[0] == "phrase":
                look = True
                if value[1]:
                    reach[value[1]] = reach.get(value[1], 0) + value[2]
            elif end >= done:
                kind, word = value
                if _in_word(low[end + 1 : end + 2]) or (end >= len(word) and _in_word(low[end - len(word)])):
                    continue
                if end >= upto:
                    upto = low.find("\n", end)
                    upto = len(low) if upto < 0 else upto
                    words = {"latin": set(), "mash": set()}
                words[kind].add(word)
                look |= len(words[kind]) >= DISTINCT
        if not look or end < done:
            continue
        start, done = low.rfind("\n", 0, end) + 1, low.find("\n", end)
        done = len(low) if done < 0 else done
        for kind, n in _line_kinds(low[start:done].strip()):
            covered += n
            if kind not in found:
                found.append(kind)
    # the document as a whole, where its phrases are long enough together (they cover no more than their lengths)
    loose = [k for k, n in reach.items() if k not in found and n >= COVER * sum(map(len, _LETTERS.findall(low)))]
    if loose:
        at = covers(low)
        for kind in loose:
            share, strong, n = _share(low, at.get(kind))
            if strong and share >= COVER:
                found.append(kind)
                covered = max(covered, n)
    if has_opener and (slots := list(_slots(plain))):
        found.insert(0, "slot")
        covered += sum(b - a for a, b in slots)
    return found, min(1.0, covered / len(text))


def _in_word(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def _slots(plain: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _OPENER.finditer(plain):
        if m.start() >= at and (slot := SLOT.match(plain, m.start())):
            at = slot.end()
            yield slot.span()


def _line_kinds(line: str) -> Iterator[tuple[str, int]]:
    """Kind and length of each segment of residue: the line as a whole, else its sentences."""
    if kind := _piece_kind(line):
        yield kind, len(line)
        return
    for piece in _SENTENCE.split(line):
        if piece and piece != line and (kind := _piece_kind(piece)):
            yield kind, len(piece)


def _piece_kind(piece: str) -> str | None:
    if _made_of(piece, LATIN_WORDS, 4) or _made_of(piece, MASH_WORDS, 5):
        return "filler"
    titled = "<" in piece and _HTML_STATUS.search(piece)
    if "<" in piece:
        piece = _TAG.sub(" ", piece).strip()
    at = covers(piece)
    if not at:
        return None
    share, strong, n = _share(piece, at.get("filler"))
    if strong and share >= 0.9:
        return "filler"
    share, strong, n = _share(piece, at.get("script_notice"))
    if strong and share >= COVER:
        return "script_notice"
    share, strong, n = _share(piece, at.get("error_page"))
    if titled and n >= 4:
        return "error_page"
    # a status code at the start makes a bare title a notice
    if n >= 4 and (strong or _STATUS.match(piece)) and share >= COVER:
        return "error_page"
    if _JSON_ERROR.match(piece) and n >= 8:
        return "error_page"
    return None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [kinds_of(t) for t in b.column(1).to_pylist()]
        kinds = pa.array([k for k, _ in got], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([b.column(0), kinds, pa.array([c for _, c in got], pa.float64())], ["doc_id", "kinds", "coverage"])


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kinds, coverage) of every document; kinds is empty for a clean one."""
    # repeated texts stay where they are: a scan is cheaper than a shuffle of the texts
    return documents.select("doc_id", "text").mapInArrow(_scan, "doc_id long, kinds array<string>, coverage double")


def found(documents: DataFrame) -> DataFrame:
    return residue(documents).filter(F.size("kinds") > 0).select("doc_id")


def kept(documents: DataFrame) -> DataFrame:
    """The corpus without such documents. Judged in the same pass, so that no join is needed."""
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: not kinds_of(t)[0])

    return documents.filter(clean("text"))


def report(documents: DataFrame) -> DataFrame:
    """Documents and mean coverage per kind."""
    each = residue(documents).select(F.explode("kinds").alias("kind"), "coverage")
    return each.groupBy("kind").agg(F.count("*").alias("n_documents"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))
