"""Records with unfilled templates, filler, error pages or demands for scripts in place of content.

Title and summary are divided into lines, at line breaks and at the marks that
sites put between a text and their name. Every line is normalised and counted
by host. Lines that recur on a host without being evidence themselves, names of
the source and host names are boilerplate and subtracted; a field is a case if
evidence is all that remains of it.

What is evidence is scored by words, not by wording: words of notices have
classes (a fault, a place, a state, a demand, scripts, slots of a template and
what fills them), classes that meet make a notice, and the score is the part of
the line that belongs to notices, codes and placeholders aside. A sentence
that only mentions an error, a placeholder or scripts has other words. A line
with a middling score is evidence if its wording stands on several hosts. Words
that repeat are filler. A field is also a case if it has two placeholders of its
own, or ends in one after a finished sentence. Evidence is never subtracted as
boilerplate: a host with three error pages has three cases.

Defined results: null, empty and blank fields are no cases; rows without an id
are left out; a row without a link shares the host "" with others of its kind;
repeated rows give one row; texts of any length are read whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressfold.session import stored

#: A line that a host has at least so often is boilerplate, however large the host.
RECURRENT = 3

#: A line is evidence if so many of its words belong to notices; from ``MAYBE`` on if it also stands on ``HOSTS`` hosts.
COVERED, MAYBE, HOSTS = 0.81, 0.76, 5
#: Copies of each boilerplate key, so that one line of many fields is looked up by several tasks.
SALT = 16

# Words of notices by what they speak of; Korean ones are beginnings of words.
_CLASSES = {
    "certain": "forbidden unauthorized unauthorised unavailable denied undefined null nan none nil traceback gone noscript captcha suspended blocked tbd untitled ipsum lorem 차단 만료",
    "fault": "error errors exception fault failed failure fails fail wrong oops whoops sorry timeout timed crashed fatal warning bad invalid trouble problem maintenance construction unexpected unable refused"
    " cannot cant couldn't can't 오류 에러 실패 점검 비정상 죄송 장애 불편",
    "place": "page pages site website server service services gateway database connection request requests session resource url address domain post app application file account permission access upstream host proxy"
    " template variable index view syntax parse side link content article client 페이지 서비스 서버 데이터베이스 접속 접근 권한 요청 세션 주소 게시글 게시물 관리자 담당자 사이트 글 연결 본문",
    "state": "found exist exists removed renamed deleted moved expired disabled missing private off down many went occurred happened displayed required requires require reached limit soon progress scheduled available"
    " back blocks unsupported support supported enabled must need needs work works looking temporarily secure processing without 찾 존재 삭제 변경 없 있 발생 꺼 않 중 일시 감지 필요 실행 동작",
    "ask": "please enable turn activate allow try retry reload refresh again wait continue sign log login contact verify verifying checking check click proceed return moment human robot disable"
    " 활성화 허용 켜 새로고침 로그인 시도 문의 확인 다시 잠시 해 이용 주세요 바랍니다",
    "script": "javascript js script scripts cookies cookie browser browsers 자바스크립트 스크립트 쿠키 브라우저",
    "slot": "document title headline summary description text copy paragraph intro introduction content body caption 제목 요약 내용 설명 본문 문구 텍스트",
    "fill": "insert add enter write here goes placeholder todo fixme sample dummy example fill 입력 여기 자리 들어갈 작성 예시 샘플",
    "": "a an the to of in on is are was were be been being this that it its your you we i our or and for with by at as if not no do does don't doesn't did have has had will would may any them then there some"
    " so more than short few minutes later before after run use view see using ad blocker line id ref reference code status http https www nginx apache just too slow nothing loading client-side out up under coming internal looks like something that's we're we'll i'm one you're"
    " 이 그 저 수 후 전 및 또는 것 에서 보려면 보 설정 사용 표시 준비 바로 이미 현재 요 합니다 입니다 됩니다",
}
#: Classes that make evidence when they meet.
_MEETINGS = {frozenset(p.split()) for p in ("fault place", "fault state", "fault ask", "place state", "place ask", "script ask", "script state", "script fault", "slot fill", "slot state", "code fault", "code place", "code state", "fill place", "ask state")}
#: Words that are evidence next to each other.
_BIGRAMS = {("not", "found"), ("went", "wrong"), ("coming", "soon"), ("under", "construction"), ("are", "human"), ("a", "moment"), ("one", "moment"), ("a", "robot")}
FILLER_WORDS = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim laborum".split()
)
PLACEHOLDER = re.compile(
    r"\[\[\s*(?:\$\{)?[\w.]+\}?\s*\]\]|\{\s?\{\s*[\w. ]{1,40}?\s*(?:\|\s*\w+[^{}]{0,40})?\}\s?\}|[$#]\{\s*[\w.]{1,40}\s*\}|<%[=-]?\s*[\w. ]{1,40}?\s*-?%>|\{%-?\s*[\w. ]{1,40}?\s*-?%\}"
    r"|@@\w+(?:\.\w+)*@@|(?<!\w)__[^\W_]\w*?(?:\.\w+)*__(?!\w)|%[A-Za-z_]{3,30}%|%\(\w{2,30}\)s|\{\d\}"
)
_SHAPED = re.compile(r"\w[.:/_]\w|[\"'`/{%@\[<$#]|\d")
#: Shapes of code within a notice, which say nothing of its language: quoted names, paths, hosts, versions, numbers.
_CODE = re.compile(r"'[^'\s]{1,40}'|\"[^\"\s]{1,40}\"|`[^`]{1,40}`|(?<!\w)/?(?:[\w.-]+/)+[\w.-]*|\b(?:[\w-]+\.)+[a-z]\w*|\bv?\d+(?:[.:]\d+)*\b|\b[0-9a-f]*\d[0-9a-f]{3,}\b")
_STATUS = re.compile(r"(?<![\w.,%$])[45]\s?\d\s?\d(?![\w%]|[.,]\d)")
_TEMPLATE = re.compile(r"[{<]|%[a-z_(>]|@@|\[\[|\[object|__")


def _templated(line: str) -> bool:
    """Whether a line has a character without which ``_TEMPLATE`` finds nothing."""
    return "{" in line or "<" in line or "%" in line or "@" in line or "[" in line or "_" in line


_THROWN = re.compile(r"(?:[a-z_$][\w$]*\.)+[\w$]*(?:exception|error)\b|\b(?:net::)?err_[a-z_]{4,40}|\[object \w+\]")
_TAGS = re.compile(r"</?(?:p|div|span|br|b|i|em|strong|h[1-6]|li|ul|a|noscript)(?:\s[^<>]*)?/?>", re.IGNORECASE)
_REFERENCE = re.compile(r"\s*\((?:ref|request|id|code|trace)[ :#]*[0-9a-f-]{4,40}\)", re.IGNORECASE)
_EDGE = " \t\u00a0※*•·;|-–—"
_FACES = (":(", ":)", "ㅠㅠ", "ᅲᅲ", "ㅜㅜ")
_PARTS = re.compile(r"\n|\s+(?:[-–—|·»]|::)\s+")


def _divided(text: str) -> bool:
    """Whether a text has something without which ``_PARTS`` divides nothing."""
    if "\n" in text or " -" in text or "|" in text or "::" in text:
        return True
    return not text.isascii() and (" –" in text or " —" in text or "·" in text or "»" in text)


_HOST = re.compile(r"(?:[\w-]+\.)+[a-z]{2,}")
_LETTER, _SIGN = re.compile(r"[^\W\d_]"), re.compile(r"[^\W_]")
_DIGIT = re.compile(r"\d")
_FINISHED = re.compile(r"(?:^|[.!?…。！？)\]\"'”’]|[다요죠음임])\s*$")


_MARKS = re.compile(r"[{%@_\[<]")
_SPACES = re.compile(r"[^\S\n]{2,}|[^\S\n ]")
_WORDS = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


class _Kinds(dict):
    """The class of each word a worker has met; None for words that do not belong to notices, "?" for what is no plain word."""

    def __init__(self) -> None:
        super().__init__()
        self.words = {w: kind for kind, words in reversed(_CLASSES.items()) for w in words.split()}
        self.stems = {w: kind for w, kind in self.words.items() if "가" <= w[0] <= "힣"}
        self.longest = max(map(len, self.stems))

    def __missing__(self, word: str) -> str | None:
        if len(self) > 1 << 20:
            self.clear()
        plain = word.strip(_AROUND).replace("’", "'")
        kind = self.words.get(plain)
        if kind is None and not plain.replace("'", "").isalpha():
            kind = "?"
        elif kind is None and "가" <= plain[0] <= "힣":
            kind = next((self.stems[plain[:n]] for n in range(min(len(plain), self.longest), 0, -1) if plain[:n] in self.stems and (n > 1 or len(plain) <= 4)), None)
        elif kind is None and "가" <= plain[-1] <= "힣":
            kind = self.words.get(_ATTACHED.sub("", plain))
        self[word] = kind
        return kind


_AROUND = ".,;:!?()[]<>…\"'“”‘’"
#: Korean particles that follow a word in Latin letters.
_ATTACHED = re.compile("(?:을|를|이|가|은|는|의|에|로)$")
_KINDS = _Kinds()


def clean(text: str) -> str:
    """The text as a reader would see it: no tags, entities, wide letters or reference numbers."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if "(" in text:
        text = _REFERENCE.sub("", text)
    if "  " in text or not text.isprintable():
        text = _SPACES.sub(" ", text)
    return text.strip()


def score(line: str) -> float:
    """How much of a normalised line belongs to a notice, 0 to 1; 0 if nothing in it makes a notice."""
    words, kinds = line.split(), _KINDS
    if len(set(words)) > 0.8 * len(words) and FILLER_WORDS.isdisjoint(words) and not (_templated(line) and _TEMPLATE.search(line)):
        unknown, most = 0, (1 - MAYBE) * len(words)  # most lines end here
        for word in words:
            if kinds[word] is None:
                unknown += 1
                if unknown > most:
                    return 0.0
    words = _WORDS.findall(line)
    if len(words) >= 3 and (len(set(words)) <= len(words) / 2 or sum(w in FILLER_WORDS for w in words) >= 0.6 * len(words) >= 2.4):
        return 1.0
    certain, thrown, seen = False, False, set()
    if _SHAPED.search(line):
        bare = PLACEHOLDER.sub(" ", line) if _MARKS.search(line) else line
        certain = bare != line
        if certain and not _SIGN.search(bare):
            return 1.0
        status, thrown = _STATUS.search(bare) is not None, _THROWN.search(bare) is not None
        rest = _CODE.sub(" ", _THROWN.sub(" ", bare))
        words = _WORDS.findall(rest)
        if not words:
            return float(thrown or (status and len(_DIGIT.findall(bare)) == 3 and not _LETTER.search(bare)))
        certain = certain or thrown
        if status or thrown:
            seen.add("code")
    if not words:
        return 0.0
    unknown, before = 0, ""
    for word in words:
        kind = kinds[word]
        unknown += kind is None or kind == "?"
        if kind and kind != "?":
            seen.add(kind)
        certain = certain or (before, word) in _BIGRAMS
        before = word
    known = 1 - unknown / len(words)
    if thrown and known >= 0.6:
        return 1.0
    return known if known >= MAYBE and (certain or "certain" in seen or any(m <= seen for m in _MEETINGS)) else 0.0


def evidence(line: str) -> bool:
    """Whether a normalised line is nothing but residue."""
    return score(line) >= COVERED


def own_placeholders(text: str) -> bool:
    """Whether a cleaned text has placeholders that should have been filled, not ones it writes about."""
    found = list(PLACEHOLDER.finditer(text)) if _MARKS.search(text) else []
    if not found:
        return False
    if len(found) >= 2:
        return True
    last = found[-1]
    return not _SIGN.search(text[last.end() :]) and bool(_FINISHED.search(text[: last.start()]))


#: Where a placeholder with a percent sign may begin.
_PERCENT = re.compile(r"%[A-Za-z_(>]")


def _content(text: str, names: set[str]) -> str | None:
    """The only line of a text in which nothing belongs to a notice, as most are; None for a text that takes a closer look."""
    if "{" in text or "<" in text or "@" in text or "[" in text or "_" in text or "&" in text or "(" in text or "  " in text or _divided(text) or not text.isprintable() or ("%" in text and _PERCENT.search(text)):
        return None
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        return None
    line = text.strip().strip(_EDGE).lower()
    words = line.split()
    if len(words) < 2 or len(set(words)) <= 0.8 * len(words) or line.endswith(_FACES) or line in names or not FILLER_WORDS.isdisjoint(words):
        return None
    unknown, most, kinds = 0, (1 - MAYBE) * len(words), _KINDS
    for word in words:
        if kinds[word] is None:
            unknown += 1
            if unknown > most:
                return line
    return None


def lines_of(text: str | None, names: set[str]) -> tuple[bool, list[tuple[str, int]]]:
    """Whether the field is a case by itself, and its lines as (normalised, kind): 2 evidence, 1 known boilerplate, -1 evidence if hosts share it, 0 other."""
    text = text or ""
    line = _content(text, names)
    return (False, [(line, 0)]) if line is not None else _closely(text, names)


def _closely(text: str, names: set[str]) -> tuple[bool, list[tuple[str, int]]]:
    """``lines_of`` for any text."""
    text = clean(text)
    if not text:
        return False, []
    if own_placeholders(text):
        return True, []
    lines = []
    for part in _PARTS.split(text) if _divided(text) else (text,):
        line = part.strip(_EDGE).lower()
        while line.endswith(_FACES):
            line = line[:-2].rstrip(_EDGE)
        if line:
            if line in names or ("." in line and _HOST.fullmatch(line)):
                lines.append((line, 1))
            else:
                known = score(line)
                lines.append((line, 2 if known >= COVERED else -1 if known else 0))
    return False, lines


_LINES = pa.schema([("id", pa.int64()), ("field", pa.int32()), ("host", pa.int64()), ("line", pa.int64()), ("kind", pa.int32()), ("wording", pa.int64())])


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(link: str | None) -> str:
    return (link or "").strip().lower().partition("://")[2].partition("/")[0].partition(":")[0].removeprefix("www.")


def names_of(site: str | None) -> set[str]:
    return {clean(site).lower()} if site else set()


def wording_of(line: str) -> int:
    return _hash(" ".join(_DIGIT.sub("", line).split()))


class Lines:
    """The lines of fields for ``settled``, as another pass over the texts meets them."""

    def __init__(self) -> None:
        self.names: dict[str | None, set[str]] = {}
        self.start()

    def start(self) -> None:
        """Begin a batch: no rows (id, field, host, line, kind, wording) of fields that may be residue, no lines that count."""
        self.rows: list[tuple] = []
        self.counted: list[int] = []

    def add(self, key: int, title: str | None, summary: str | None, link: str | None, site: str | None) -> None:
        host, names = host_of(link), self.names.get(site)
        if names is None:
            names = self.names[site] = names_of(site)
        for field, text in (("t", title), ("s", summary)):
            if not text:
                continue
            whole = _content(text, names)
            if whole is not None:
                self.counted.append(_hash(f"{host}\x01{whole}"))
                continue
            case, lines = _closely(text, names)
            if case:
                lines = [("", 3)]
            hashed = [(_hash(f"{host}\x01{line}"), kind, line) for line, kind in lines]
            self.counted += [line for line, kind, _ in hashed if kind in (0, -1)]
            if any(kind not in (0, 1) for _, kind, _ in hashed):
                self.rows += [(key, field, _hash(host), line, kind, wording_of(text) if kind == -1 else None) for line, kind, text in hashed]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line of a field; kind 3 for a field that is a case by itself; the wording, without numbers, of lines that other hosts may settle."""
    for b in batches:
        known: dict[str | None, set[str]] = {}
        columns = ids, fields, hosts, found, kinds, wordings = [], [], [], [], [], []
        for key, title, summary, link, site in zip(*(b.column(c).to_pylist() for c in ("id", "title", "summary", "link", "site")), strict=True):
            host = host_of(link)
            place = _hash(host)
            names = known.get(site)
            if names is None:
                names = known[site] = names_of(site)
            for field, text in ((0, title), (1, summary)):
                if not text:
                    continue
                case, lines = lines_of(text, names)
                if case:
                    lines = [("", 3)]
                for line, kind in lines:
                    ids.append(key)
                    fields.append(field)
                    hosts.append(place)
                    found.append(_hash(f"{host}\x01{line}"))
                    kinds.append(kind)
                    wordings.append(wording_of(line) if kind == -1 else None)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINES, strict=True)], schema=_LINES)


def site_names(sources: DataFrame) -> DataFrame:
    """(corporation_id, site): the name of each source (id, name)."""
    return sources.groupBy(F.col("id").alias("corporation_id")).agg(F.min("name").alias("site"))


def residue(records: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id) of the records whose title or summary is residue.

    ``records`` needs id, corporation_id, title, summary and link; ``sources``
    (id, name) gives names that are boilerplate wherever they stand alone.
    """
    own = records.select("id", "corporation_id", "title", "summary", "link").where("id is not null")
    if sources is None:
        own = own.withColumn("site", F.lit(None).cast("string"))
    else:
        own = own.join(site_names(sources), "corporation_id", "left")
    lines = own.select("id", "title", "summary", "link", "site").mapInArrow(_lines, "id bigint, field int, host bigint, line bigint, kind int, wording bigint")
    lines = stored(lines)
    return settled(lines, lines.where("kind <= 0 and kind >= -1").select("line"))


def settled(lines: DataFrame, counted: DataFrame) -> DataFrame:
    """(id) of the residue among ``lines`` (id, field, host, line, kind, wording).

    ``lines`` must have all lines of a field if one is more than content or a
    name; ``counted`` (line) has the lines of all fields but evidence and names.
    """
    shared = lines.where("kind = -1").select("wording", "host").distinct().groupBy("wording").count().where(F.col("count") >= HOSTS)
    doubtful = lines.where("kind = -1").join(shared.select("wording", F.lit(2).alias("settled")), "wording", "left")
    doubtful = doubtful.select("id", "field", "host", "line", F.coalesce("settled", F.lit(0)).alias("kind"))
    sure = lines.where("kind >= 2").select("id", "field").unionByName(doubtful.where("kind = 2").select("id", "field"))
    fields = stored(sure.distinct())
    # what else stands in these fields is content, unless it recurs on its host
    rest = lines.where("kind = 0").select("id", "field", "host", "line").unionByName(doubtful.where("kind = 0").drop("kind")).join(fields, ["id", "field"], "left_semi")
    rest = stored(rest)
    # partial counts are made before the shuffle, so a host with most of the rows is no heavier than others
    counted = counted.join(rest.select("line").distinct(), "line", "left_semi").groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= RECURRENT)
    boilerplate = counted.select("line", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    content = rest.withColumn("salt", F.pmod(F.xxhash64("id", "field"), F.lit(SALT)).cast("int")).join(boilerplate, ["line", "salt"], "left_anti")
    certain = lines.where("kind = 3").select("id")
    return fields.join(content.select("id", "field").distinct(), ["id", "field"], "left_anti").select("id").unionByName(certain).distinct()
