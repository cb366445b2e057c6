"""Template residue, filler, error pages and demands for scripts in place of content (problem 8)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq
from re import _parser as _parse

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import require_columns, shared_dir

# Placeholder and phrase rules. They see one message at a time, in small letters and single blanks: the placeholder
# rules as it stands, the phrase rules with numbers masked by 0 and addresses by @. None has a length limit.
_NAME = r"[a-z][a-z0-9_ .\-]+"
# What fields of forms and letters are called.
FIELD = "name|title|date|time|day|month|year|address|street|city|state|country|zip|email|e-mail|phone|number|amount|price|value|symbol|ticker|link|url|logo|image|author|position|subject|signature|percentage|quantity|company|client|customer|description"
SLOT = (
    r"\{\{[^{}]*\}\}",
    r"\{%[^{}]+%\}",
    r"\$\{[a-z_][a-z0-9_. ]*\}",
    r"(?<![\\_^$a-z0-9}{])\{[a-z][a-z0-9_]{2,}\}",
    r"(?<![\\_^$a-z0-9}])\{[0-9]*:?[.0-9]*[dfs]\}",
    r"%\([a-z][a-z0-9_]+\)[sdf]",
    r"%[a-z][a-z0-9_]{2,}%",
    r"@@[a-z][a-z0-9_ ]+@@",
    r"<%=?[^<>]+%>",
    r"<(?:your [a-z0-9_ \-]{2,}|[a-z0-9_ \-]+[_ \-]here)>",
    rf"<<{_NAME}>>",
    rf"«{_NAME}»",
    rf"\[\[{_NAME}\]\]",
    r"\[(?:insert [^\[\]]+|[^\[\]]+ goes here|tbd|todo)\]",
    rf"\[(?:your |[a-z]+ )?(?:{FIELD})\](?![(\[:])",
    r"(?<![a-z0-9])__[a-z][a-z0-9_]+__(?![a-z0-9])",
    r"(?<![a-z0-9])x{2,3}[.:]x{2,3}(?![a-z0-9])",
    r"××[^×]+××",
    r"[〔(](?:请|此处)填写[^〕)]*[〕)]",
    r"【[一-鿿]+】",
    r"(?<=[^ #] )####(?![#a-z0-9])",
    r"<!.{1,6} [^<>]*\$[a-z_]{3,}",
)
# Words right before or behind a slot that speak about it: then it is explained, not left unfilled.
_ABOUT = r"(?:write|writes|type|types|use|uses|using|escape|syntax|variable|variables|placeholder|placeholders|macro|macros|token|tokens|slot|slots|field|fields|called|notation|expression)"
_MEANS = r"(?:to (?:group|escape|mark|denote|refer|insert|expand)|in (?:your|the|a|an) (?:shell|template|script|code|file|configuration|config|string)|expands|stands for|means|denotes|marks|is (?:replaced|expanded|substituted|a (?:placeholder|variable|macro|slot)|the (?:placeholder|variable|syntax))|are (?:replaced|expanded|substituted|placeholders|variables))"
# The words of the usual filler Latin.
LATIN = (
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse "
    "cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum"
).split()
_LATIN = rf"\b(?:{'|'.join(LATIN)})\b"
FILLER = (
    r"\blorem ipsum\b",
    rf"(?:{_LATIN}[ ,.]*(?:(?:sed|sit|et|ut|in|non|do|ex|ea|ad|qui|est|id) )*){{4}}",
    r"(?:text|copy|commentary|content|comment|title|body) goes here\b",
    r"^(?:add|insert|enter|put) [a-z ]+ here[.!]",
    r"^text to be (?:supplied|added|provided)\b",
    r"^replace (?:this )?before publish",
    r"^this is dummy text|^this is placeholder text|^this is sample text|^this is filler text",
    r"^(?:sample|dummy|placeholder) (?:paragraph|text|copy|content) (?:for|only|goes)",
    r"^(?:blindtext|platzhaltertext|beispieltext)\b",
    r"^texto de (?:relleno|ejemplo|muestra)\b",
    r"此段落仅用于排版测试|这里是示例文字|(?:标题|内容)占位",
    r"^(?:(?:heading|caption|bullet|paragraph) 0(?: text| ?…| ?\.\.\.)? ?)+$",
    r"(?:(?:heading|caption|bullet|paragraph) 0(?: text| ?…| ?\.\.\.)? ?){3}",
    r"\b([a-z]{2,10})(?: \1\b){4}",
    r"\b([a-z]{2,10} [a-z]{2,10})(?: \1\b){3}",
)
_REASON = (
    r"(?:bad request|unauthorized|forbidden|(?:page )?not found|request timeout|gone|too many requests|internal server error"
    r"|bad gateway|service unavailable|gateway timeout)"
)
_AFTER = r"(?: ?[.!]?$| ?[.!]? (?:request|reference|reason|error id|please|contact|go back|return to|try again|slow down|the (?:page|requested)|[^ -~]))"
_MENU = r"^(?:[a-z]+ (?:\| [a-z]+ ?)+(?:in )?)?"
ERROR = (
    rf"{_MENU}(?:#+ )?(?:error |fehler |http status |http/0 |status )?0 ?(?:[-–:] )?\(?{_REASON}\)?{_AFTER}",
    rf"{_MENU}(?:error |http status |http/0 )0\b ?(?:[-–:] )?\(?{_REASON}",
    rf"{_MENU}{_REASON}[.!]?$",
    rf"^reason: {_REASON}",
    r"<title>0\b",
    r"^(?:the )?requested (?:file|page|url|resource|document) was not found\b",
    r"^(?:this|the) (?:document|page|note|report) could not be (?:displayed|loaded|found)",
    r"^you do not have permission to (?:view|access)",
    rf"{_MENU}your session has expired[.!]",
    r'\{"(?:message|error)": ?"[a-z_ ]+", ?"(?:code|status)": ?0',
    r"<error> ?<code>",
    r"^(?:[a-z]+ )?(?:connection|server|service|gateway|query|request) (?:failed|refused|timed out): (?:could not|cannot|can't|unable to|no) ",
    r"traceback \(most recent call last\)",
    r"您没有权限访问(?:该|此|本)?页面|^会话已过期|页面(?:不存在|未找到)|^系统繁忙|服务器内部错误",
    r"^zugriff verweigert[.!]|^(?:ihre )?sitzung ist abgelaufen|fehler 0.{0,6}seite nicht gefunden|^der dienst ist vor.{1,4}bergehend nicht erreichbar",
    r"error 0.{0,6}p.{1,3}gina no encontrada|^el servicio no est.{1,3} disponible|^acceso denegado[.!]|^su sesi.{1,3}n ha (?:caducado|expirado)",
)
# What error pages speak of, and what they say of it. Such messages also occur in reports, so they count only where
# the same masked message recurs widely, which what somebody wrote once does not.
_OF = (
    r"(?:(?:web ?)?(?:page|site)|file|document|report|note|chart|dashboard|content|resource|url|link|address|(?:[a-z\-]+ )?(?:server|service|gateway|proxy|database|connection|request|session|host|browser|application|app)"
    r"|access(?: to [a-z ]+)?|login|token|certificate|download|account)"
)
_NEGATIVE = "|".join(
    f"{no} {done}" for no in (" not", " not be", " cannot", " cannot be", " can't", " can't be", "n't", "n't be")
    for done in "found available reachable reached displayed loaded shown opened processed completed receive respond exist".split()
)
_STATE = "|".join(
    f" {was} {how}" for was in ("was", "is", "are", "has been")
    for how in "reset|denied|refused|blocked|forbidden|unavailable|unreachable|closed|expired|disabled|suspended|overloaded|too busy|down for|offline|out of date|at capacity|timed out".split("|")
)
_FAILED = (
    rf"(?:(?: (?:was|is|are|were|has been|could|did|does|do))?(?:{_NEGATIVE})\b|(?:{_STATE})\b"
    r"| has moved\b| have moved\b| has expired\b| have expired\b| has failed\b| timed out\b| failed\b|(?: is| was| are)? no longer (?:exists|available|exist|supported)\b|(?: is| was| are)?(?: temporarily| currently)? unavailable\b)"
)
_SORRY = r"(?:(?:sorry|oops|whoops|error|warning|notice|attention|uh-oh)[,.!: ]+(?:but )?)?"
WIDE_ERROR = (
    rf"{_MENU}{_SORRY}(?:the |this |that |your |our )?(?:requested )?{_OF}(?: (?:you (?:are|were) looking for|you requested))?{_FAILED}",
    rf"{_MENU}{_SORRY}(?:access|permission|request|connection) (?:denied|refused|forbidden)[.!]?(?:$| )",
    rf"^{_SORRY}(?:something|an error|an unexpected error|a problem) (?:went wrong|occurred|has occurred)\b",
    rf"^{_SORRY}(?:we are|we're|we will be|the (?:site|service|page) is) (?:currently |temporarily )?(?:down for|offline|closed for|unavailable) ",
    rf"^{_SORRY}you (?:do not|don't) have (?:permission|access|the rights?)\b",
    rf"^{_SORRY}too many (?:requests|attempts|connections)\b",
    rf"^(?:error )?0 {_REASON}\b",
)
WIDE_FILLER = (
    r"^(?:example|sample|dummy|placeholder|filler) (?:note|text|copy|paragraph|content|title|heading|caption|body|entry|document)s?\b[.!]?$",
    r"^lorem (?:lines?|text|copy|paragraphs?|ipsum)\b",
    r"^(?:text|copy|content|note|body|caption|commentary) (?:to follow|to come|follows|pending|coming soon|to be (?:added|supplied|provided|written|confirmed))\b",
    r"^(?:coming soon|under construction|untitled|no content yet|content coming soon)[.!]?$",
    r"^click (?:here )?to (?:add|edit) (?:text|title|subtitle|a title|notes|content)\b",
)
WIDE_SCRIPT = (
    r"^(?:please )?(?:reload|refresh) (?:the|this) page (?:with|after) [a-z ]*(?:javascript|scripts|cookies)\b",
    r"^(?:this|our|the) (?:site|page|app|application|website|dashboard) (?:works|runs|is best viewed) (?:only |best )?with [a-z ]*(?:javascript|scripts|cookies)\b",
    r"^(?:cookies|javascript|scripts?) (?:must|have to|need to|should) be (?:enabled|allowed|turned on|switched on|activated)\b",
    r"^(?:one moment|please wait|just a moment)[,.! ]+(?:while )?(?:we (?:are )?)?(?:check|checking|verify|verifying) ",
)
_SWITCH = r"(?:enable|turn on|switch on|activate|allow|unblock|permit)"
_SCRIPTS = r"(?:(?:(?:client.{1,3}side |active )?(?:javascript|js|scripts?|scripting|cookies)\b)(?: and |, )?)+"
SCRIPT = (
    rf"(?:^|, |please |kindly |must |need to |access )(?:please )?{_SWITCH} {_SCRIPTS}(?: ?[.,!]| ?$| (?:in|for|to|on|then|and)\b)",
    r"(?:javascript|scripts?) (?:is|are) (?:disabled|blocked|switched off|turned off|not enabled)",
    rf"(?:requires?|needs?) (?:enabled |active )?{_SCRIPTS} ?(?:to be )?(?:switched on|enabled|turned on|activated)",
    r"checking your browser|verify that you are human",
    r"(?:does|will|do) not (?:work|run) without (?:javascript|scripts)",
    r"请启用 ?(?:javascript|脚本)|浏览器未(?:开启|启用)脚本|正在检查您的浏览器",
    r"bitte aktivieren sie (?:javascript|skripte)|ben.{1,3}tigt aktivierte skripte",
    r"active javascript para|necesita scripts y cookies",
)

_REPEATED = tuple(r for r in FILLER if r"\1" in r)
_FOUR_WORDS = FILLER[1]
ONCE = {"filler": FILLER, "scripts demanded": SCRIPT, "error page": ERROR}
WIDELY = {"filler": WIDE_FILLER, "scripts demanded": WIDE_SCRIPT, "error page": WIDE_ERROR}


def needles(rule: str, masked: bool = True, widest: int = 64) -> set[str]:
    """Literals of which every text that the rule accepts holds at least one; empty if the rule has none.

    Derived from the rule itself: of a sequence any literal stretch will do, of alternatives each needs one of its own,
    a small set of characters multiplies the stretch it belongs to. Of several choices the longest is taken, where
    marks count more than letters. In masked messages 0 and @ may stand for something else, so no literal reaches over them.
    """

    def weigh(found: set[str]) -> tuple[int, int]:
        return (min(sum(4 if not c.isascii() else 1 if c.isalnum() or c == " " else 3 for c in x) for x in found), -len(found)) if found else (0, 0)

    def letters(value) -> set[str]:
        """The characters of a set, none if they are many or the set is a negative or a named one."""
        out: set[str] = set()
        for kind, x in value:
            if kind is _parse.LITERAL:
                out.add(chr(x))
            elif kind is _parse.RANGE and x[1] - x[0] < widest:
                out |= {chr(i) for i in range(x[0], x[1] + 1)}
            else:
                return set()
        return set() if masked and out & set("0@") else out

    def of(parts) -> tuple[set[str], str | None]:
        """(needles, the whole text where the parts are a fixed one)"""
        options, run, fixed = [], {""}, True
        for op, value in parts:
            if op is _parse.LITERAL and not (masked and chr(value) in "0@"):
                run = {x + chr(value) for x in run}
                continue
            if op is _parse.IN and (chars := letters(value)) and len(run) * len(chars) <= widest:
                run, fixed = {x + c for x in run for c in chars}, False
                continue
            if op is _parse.SUBPATTERN:
                inner, text = of(value[3])
                if text is not None:
                    run = {x + text for x in run}
                    continue
                options.append(inner)
            elif op is _parse.BRANCH:
                each = [of(branch)[0] for branch in value[1]]
                options.append(set().union(*each) if all(each) else set())
            elif op is _parse.MAX_REPEAT and value[0] >= 1:
                inner, text = of(value[2])
                if text is not None:  # as many copies as there must be join what stands before and what comes next
                    options.append({x + text * value[0] for x in run})
                    run, fixed = {text * value[0]}, False
                    continue
                options.append(inner)
            elif op in (_parse.AT, _parse.ASSERT, _parse.ASSERT_NOT):
                continue
            fixed = False
            options.append(run - {""})
            run = {""}
        options.append(run - {""})
        return max(reversed(options), key=weigh), next(iter(run)) if fixed else None

    return of(_parse.parse(rule))[0]


_UNSEEN = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_QUOTED_CODE = re.compile(r"`[^`\n]+`")
_SPLIT = re.compile(r"\n+|(?<=[.!?…])[ ]+|(?<=。)")
_ADDRESS = re.compile(r"https?://\S+|[\w.+-]+@[\w-]+\.[\w.]+|\b[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|invalid|test|csv|html?)\b")
_NUMBER = re.compile(r"\b[0-9a-f]*\d[0-9a-f]{5,}\b|\d[\d.,:/\-–]*\d|\d")


@dataclass(frozen=True)
class Recurrence:
    """When a message counts as widely recurring."""

    documents: int = 2
    sources: int = 2


#: Words of filler Latin that a message needs.
ENOUGH = 4


def _signs() -> ahocorasick.Automaton:
    """Finds what a rule needs: any of its needles, or four words of filler Latin."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    weight = dict.fromkeys(LATIN, 1)
    for rule in SLOT:
        weight |= dict.fromkeys(needles(rule, masked=False), ENOUGH)
    for rules in (*ONCE.values(), *WIDELY.values()):
        for rule in rules:
            if rule not in _REPEATED and rule != _FOUR_WORDS:
                weight |= dict.fromkeys(needles(rule), ENOUGH)
    for sign, w in weight.items():
        found.add_word(sign, w)
    found.make_automaton()
    return found


def _repeats(text: str) -> bool:
    """Could a word or a pair of words stand there four times in a row? The inner copies are whole words between blanks."""
    words = text.split()
    return any(map(eq, words, islice(words, 1, None))) or b"\1\1\1" in bytes(map(eq, words, islice(words, 2, None)))


def _marked(text: str, signs: ahocorasick.Automaton) -> bool:
    seen = 0
    for _, weight in signs.iter(text):
        seen += weight
        if seen >= ENOUGH:
            return True
    return _repeats(text)


_SLOTS = re.compile("|".join(SLOT))
_EXPLAINED_BEFORE = re.compile(rf"\b{_ABOUT}:? (?:the |a |an )?[\"'“]?$")
_EXPLAINED_BEHIND = re.compile(rf"[\"'”]?,? {_MEANS}\b")


def unfilled_slot(message: str) -> bool:
    """Does the message hold a slot that nothing beside it explains?"""
    for m in _SLOTS.finditer(message):
        if not _EXPLAINED_BEFORE.search(message[: m.start()]) and not _EXPLAINED_BEHIND.match(message[m.end() :]):
            return True
    return False


def plain_text(text: str) -> str:
    """Compatibility forms folded, invisible characters dropped, small letters, single blanks, line breaks kept."""
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    elif not any(x in text for x in ("  ", "\t", "\r", " \n", "\n ", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")):
        return text.lower().strip(" ")
    return "\n".join([" ".join(line.split()) for line in text.lower().splitlines()])


def mask(message: str) -> str:
    """Numbers and dates become 0, addresses @."""
    return _NUMBER.sub("0", _ADDRESS.sub("@", message))


def messages_of(text: str, signs: ahocorasick.Automaton) -> dict[str, bool]:
    """The masked messages of a text that a rule could accept, each with whether it holds an unfilled slot. Code
    blocks and code in a sentence show or explain something, so they are left out."""
    plain = plain_text(text)
    if not _marked(plain, signs):
        return {}
    plain = _QUOTED_CODE.sub(" ", _FENCED.sub("\n", plain))
    out: dict[str, bool] = {}
    for part in _SPLIT.split(plain):
        part = part.strip().lstrip("-*> ")
        if part and _marked(part, signs):
            message = mask(part)
            out[message] = unfilled_slot(_ADDRESS.sub("@", part)) or out.get(message, False)
    return out


def _any(message: Column, rules: Iterable[str]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | message.rlike(rule)
    return out


def classified_messages(candidates: DataFrame, recurring: Recurrence = Recurrence()) -> DataFrame:
    """(h, message, n_documents, n_sources, kind) per distinct message; kind is null for ordinary ones.

    Messages are grouped by the hash of their masked form, per source first, so that a message which a third
    of all documents share is counted before it is shuffled. Those that recur widely are classified by the broad
    rules of what error pages, fillers and notices say; what unmistakably is a template's slot, filler, a status line or a
    demand for scripts is one wherever it stands.
    """
    per_source = candidates.groupBy("h", "source").agg(F.count("*").alias("n"), F.max("slot").alias("slot"), F.min("message").alias("message"))
    groups = per_source.groupBy("h").agg(F.sum("n").alias("n_documents"), F.count("*").alias("n_sources"), F.max("slot").alias("slot"), F.min("message").alias("message"))
    text = F.col("message")
    wide = (F.col("n_documents") >= recurring.documents) & (F.col("n_sources") >= recurring.sources)
    kind = F.when(F.col("slot"), "unfilled slot")
    for name, rules in ONCE.items():
        kind = kind.when(_any(text, rules) | (wide & _any(text, WIDELY[name])), name)
    return groups.withColumn("kind", kind).drop("slot")


def candidate_messages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, h, message, slot): each document's messages that a rule could accept, once each. The gate is
    derived from the rules (`needles`), so a message that it stops is one that no rule accepts, however often it recurs."""
    require_columns(documents, doc_id, text, source)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = _signs()
        for batch in batches:
            row, found, slots = [], [], []
            for i, value in enumerate(batch.column(2)):
                body = value.as_py()
                if body:
                    held = messages_of(body, signs)
                    row += [i] * len(held)
                    found += held
                    slots += held.values()
            at = pa.array(row, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.string()), pa.array(slots, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "message", "slot"])

    kind = documents.schema[doc_id].dataType.simpleString()
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, source string, message string, slot boolean").withColumn("h", F.xxhash64("message"))


def residue_documents(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", recurring: Recurrence = Recurrence()
) -> DataFrame:
    """(doc_id, kinds): the documents that carry residue anywhere in their text, with the kinds found.

    Null, empty and blank texts carry none. Copies of a text are judged alike. A null source counts as one of its own. The
    candidates are few; they are written once to the shared folder, grouped by hash across sources, classified once per distinct
    message, and joined back to their documents.
    """
    shared_dir(documents.sparkSession)
    candidates = candidate_messages(documents, doc_id, text, source).checkpoint()
    bad = classified_messages(candidates, recurring).where("kind is not null").select("h", "kind")
    hit = candidates.select("doc_id", "h").join(bad, "h").select("doc_id", "kind").distinct()
    return hit.groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds")).withColumnRenamed("doc_id", doc_id)
