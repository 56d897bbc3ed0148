"""Template residue, filler, error pages and notices that scripts are required.

The messages (lines and sentences) of the corpus go through a prefix tree of fixed depth: number of words, then the first
``DEPTH`` known words.  Messages of a leaf that agree in most places share a template; where they disagree it has a variable.
Each template is judged once, by phrase rules or else by a classifier of templates, and the verdict is propagated to the
messages and their documents.  The classifier is fitted on the templates of all documents, which the rules label: in parts of
about ``PART`` documents, of whose models it is the mean.
Unresolved slots are looked for in every message by itself, as they stand in messages that are ordinary otherwise.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import eq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.llm import verdicts
from graphweft.llm.text import LATIN, LOOKALIKES, fold
from graphweft.session import cut, discard, fresh_path

DEPTH = 3
#: Messages share a template if they agree in this share of the places where either has a known word.
AGREE = 0.6
#: Documents, about, of a part; all documents are in parts.
PART = 5000
#: A word is known if it is in messages of so many in ``PART`` of all documents, and of so many at least, or in a rule.
KNOWN_IN = 4
#: What a template that a rule judges weighs beside one of content; content weighs 1 to 3 by its documents.
JUDGED_WEIGHT = 10.0
#: The classifier has no say on messages with more unknown words (names and the like) than this share.
UNKNOWN = 0.2
#: Judged forms are broadcast up to this size, beyond it joined by a shuffle.
BROADCAST_CHARS = 20_000_000

# The words of a well-known filler text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad "
    "minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit "
    "voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia "
    "deserunt mollit anim id est laborum".split()
)
# Phrases by which such messages are told, on folded text in which a number is 0.
SCRIPT = r"(?:client side scripts?|javascript|js|scripts?|scripting)"
ON = r"(?:enable|activate|allow|permit|unblock|turn on|switch on)"
THING = r"(?:page|entry|record|file|document|article|link|item|link target|section|place|site|content)"
ASKED = rf"(?:please|kindly|sorry|to continue|you (?:need|have|must|should|will have)(?: to)?|in order to \w+)"
PHRASES: dict[str, tuple[str, ...]] = {
    "script": (
        rf"{ASKED} (?:\w+ )?{ON} (?:\w+ ){{0,2}}?{SCRIPT}\b",
        rf"^{ON} {SCRIPT}\b",
        rf"\b(?:this|our|the|your|content here) ?(?:\w+ ){{0,3}}(?:requires?|needs?|depends? on|relies on|works? only with|(?:will|does|do|can) ?not (?:\w+ )?(?:load|work|run|open)(?: properly)? without|cannot run the) {SCRIPT}\b(?! (?:yield|was|were))",
        rf"\b{SCRIPT} (?:is|are|has been|have been|seems?|appears?)(?: to be)?(?: \w+){{0,2}} ?(?:disabled|off|blocked|inactive)\b",
        r"^turn (?:it|them) on and reload\b",
        r"\bcheck that scripts are not blocked\b",
        rf"\bbitte (?:aktivieren|schalten) sie {SCRIPT}|{SCRIPT} (?:aktivieren|einschalten)\b",
        rf"\b(?:veuillez|merci d) ?(?:activer|autoriser) {SCRIPT}|\b(?:active|habilite|activez|por favor active) {SCRIPT}\b",
        r"включите javascript|javascript ?を有効|(?:启用|开启|打开|允许) ?javascript|需要 ?javascript",
    ),
    "error": (
        r"^(?:\w+ ){0,3}(?:http (?:status )?|error )?0 (?:not found|forbidden|bad gateway|bad request|service unavailable|internal server error|gateway time ?out|unauthori[sz]ed|too many requests|moved permanently)\b",
        r"^(?:\w+ ){0,3}error 0(?: |$)",
        r"^(?:\w+ ){0,3}(?:service (?:temporarily )?unavailable|forbidden|access denied|permission denied|page not found|not found|internal server error|bad gateway|no results|no results found)$",
        r"\bwe (?:can ?not|cant|could not|couldnt) find the page\b",
        rf"\b(?:the|that|this) {THING} (?:\S+ ){{0,3}}does not exist (?:on this server|any ?more)\b",
        rf"\b(?:that|the|this) {THING} (?:you (?:followed|requested|were looking for|are looking for) )?is no longer (?:here|available)\b",
        r"^(?:\w+ ){0,3}the entry (?:\S+ ){0,4}is not available in your region\b",
        rf"\brequested {THING} is not available\b",
        rf"\byou (?:are not allowed|do not have permission|have no permission) to (?:see|view|access) (?:this|the|that) {THING}\b",
        r"\byour session has expired\b|\bsign in again to continue\b",
        r"\brequest timed out while\b|\btoo many requests from\b|^slow down and retry after\b",
        r"\ban (?:unexpected|internal|unknown) error (?:occurred|happened)\b|\bsomething went wrong\b",
        r"^(?:\w+ ){0,3}traceback most recent call last\b|^(?:\w+ ){0,3}file \S+ py line 0\b",
        r"\bjava lang \w+(?:exception|error)\b|^(?:\w+ ){0,3}\w+(?:error|exception) (?:errno|0|\w+)",
        r"^(?:\w+ ){0,3}fatal (?:error )?(?:could not|cannot|unable)|\bunable to parse response\b|^(?:\w+ ){0,3}warning undefined variable\b",
        r"\berror code 0 message\b|\bbackend failed\b|^(?:\w+ ){0,3}panic runtime error\b|^(?:\w+ ){0,3}segmentation fault\b",
        r"страница не наидена|页面不存在|^error del servidor\b|^vuelva a intentarlo|seite (?:wurde )?nicht gefunden|page (?:introuvable|non trouvee)|pagina no encontrada|ヘーシか見つかりません|erreur (?:interne )?du serveur|serverfehler|ошибка сервера|服务器错误",
    ),
    "filler": (
        r"^(?:\w+ ){0,3}(?:dummy|sample|test) (?:value|record|entry|text|row|data)(?: 0)?(?: please ignore)?(?: 0)?$|\btest entry please ignore\b",
        r"^(?:\w+ ){0,3}(?:tbd|tba|tbc|coming soon|more text here|to be (?:added|written|done)|placeholder)$",
        r"\bdescription (?:to follow|pending)\b|\b\w+ section pending\b|\bsection has no content yet\b|\bthis is (?:a )?(?:sample|placeholder|dummy) text\b",
        r"\b(?:your|caption|text|title|heading|paragraph|description)(?: \w+)? goes (?:here|in this place)\b|^(?:\w+ ){1,4}goes (?:here|in this place)$",
        r"^(?:\w+ ){1,4}(?:under construction|pending)$",
        r"^(?:\w+ ){0,3}(?:type|write|put|insert|enter|add) (?:your|the|a) (?:\w+ ){1,4}?(?:below|here|at this spot|in this box)\b",
        r"^(?:\w+ ){0,3}todo (?:write|add|fill|describe)\b|^(?:\w+ ){0,3}fixme\b|\breplace it with a real\b",
        r"\bhier steht spater ein beispieltext\b|\btexte d ?exemple\b|\btexto de ejemplo\b|\bпример текста\b|示例文本|サンフルテキスト",
        r"\b(?:null null null|undefined undefined)\b|^(?:\w+ ){0,3}object object$",
    ),
}
#: Nothing but a word or two said again and again.
REPETITION = re.compile(r"^(?:\w+ ){0,3}(?:(\w{2,})(?: \1){2,}|(x+|z+)(?: [xz]+){2,}|(?:asdf|qwer|jkl|qwerty|zxcv)(?: (?:asdf|qwer|jkl|qwerty|zxcv)){2,}|(\w+ \w+)(?: \3){2,})(?: \w+)?$")
RULES = [(kind, re.compile(p)) for kind, patterns in PHRASES.items() for p in patterns]
_ASKED = re.findall(r"([^\W\d_]+)(\??)", re.sub(r"\\[bwSsd]|\(\?", " ", " ".join(p for ps in PHRASES.values() for p in ps)))
#: The words the rules ask for, with and without letters they leave open.
CONSTANT = frozenset(w for word, optional in _ASKED for w in ((word, word[:-1]) if optional else (word,)) if w) | {"unauthorized", "unauthorised", "timeout", "dexemple"}

FIELD = r"\s*(?:\d+:)?\s*(?:[a-z]\w*\.){0,3}[^\W\d_]+(?:[_ ]?[^\W\d_]+){0,3}\s*"
NAME = r"(?:\d+:)?(?:item\.)?[^\W\d_]+(?:_?[^\W\d_]+){0,3}"
SLOTS = re.compile(
    rf"\{{\{{{FIELD}\}}\}}|\{{%{FIELD}%\}}|<%=?{FIELD}%>|#\{{{FIELD}\}}|%\({FIELD}\)s|@@{NAME}@@|<<{NAME}>>|\[\[{NAME}\]\]|&lt;{NAME}&gt;"
    rf"|(?<!\w)__{NAME}__(?!\w)|(?<![\w$])\${NAME}\$(?!\w)|(?<![\w%])%{NAME}%(?!\w)"
    rf"|\[\s*insert{FIELD}here\s*\]|\[\s*your {FIELD}\]|\({FIELD}goes here\s*\)|\[{FIELD}to be added\s*\]",
    re.IGNORECASE,
)
#: Without one of these there is no slot.
MARKS = re.compile(r"[{\[<%@#$(_]|&lt;|\b(?:INSERT|ENTER|ADD|PUT)\b")
#: Slots told by capitals, which are what is left to fill in.
CAPITALS = re.compile(r"\[(?:YOUR |THE )?(?:NAME|FIRST NAME|LAST NAME|TITLE|DATE|COMPANY|ADDRESS|CITY|EMAIL|PHONE|TEXT|URL|LINK|AUTHOR|SUBJECT)(?: HERE)?\]|\b(?:INSERT|ENTER|ADD|PUT) (?:[A-Z]+ ){1,3}HERE\b")
#: Forms that text about programs and markup has as well.
LOOSE = re.compile(rf"\$\{{{NAME}\}}|(?<![\{{#$%]|\w)\{{{NAME}\}}(?!\}})|(?<![<\w])<({NAME})>(?!>)")
ABOUT = re.compile(r"\b(?:templates?|slots?|config|adapter|arguments?|map keys?|prints|syntax|notes on|placeholders?)\b", re.IGNORECASE)
# Tags of markup, which are no slots.
TAGS = frozenset("a b i u p q s br hr em h1 h2 h3 h4 h5 h6 li ol ul td th tr pre sub sup div span code html body head table strong small img title script style".split())
QUOTED = re.compile(r"`[^`]*`|f?\"[^\"]*\"|“[^”]*”")
TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>|\*\*")
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
WORDS = re.compile(r"[^\W_]+")


def has_slot(message: str) -> bool:
    """Whether a message has a slot that should have been filled.  Quoted text is text about something, and so are loose
    forms in a message about templates or programs."""
    if not MARKS.search(message):
        return False
    bare = QUOTED.sub(" ", message)
    if SLOTS.search(bare) and not (ABOUT.search(bare) and not SLOTS.search(ABOUT.sub(" ", bare))):
        return True
    if CAPITALS.search(bare) and not bare.isupper():
        return True
    for m in LOOSE.finditer(bare):
        name = m.group(1)
        if name and (name.lower() in TAGS or f"</{name}>".lower() in message.lower()):
            continue
        if m.group().startswith("$") and bare[m.end() : m.end() + 1] == "/":
            continue
        if not ABOUT.search(bare):
            return True
    return False


def said(text: str) -> Iterator[tuple[str, bool, bool]]:
    """Lines and sentences of a text as folded words, whether each has a slot, and whether it is a sentence of a line.  A
    sentence that runs over a line break is a message too."""
    text = text.translate({0x200B: None, 0xFEFF: None, 0xAD: None, 0x2060: None})
    lines = text.split("\n")
    sentences = {s for line in lines for s in SENTENCE.split(line)}
    for part in sentences.union(lines, SENTENCE.split(re.sub(r"\s*\n\s*", " ", text))):
        if part.strip():
            found = [w if w.isascii() or not LATIN.search(w) else w.translate(LOOKALIKES) for w in WORDS.findall(fold(TAG.sub("", QUOTED.sub(" ", part) if not part.lstrip().startswith(("{", "KeyError", "File")) else part)))]
            yield " ".join("0" if w.isdigit() else w for w in found), has_slot(latin(part)), part in sentences


def messages(text: str) -> Iterator[tuple[str, bool]]:
    """Lines and sentences of a text as folded words, and whether each has a slot."""
    return ((m, slot) for m, slot, _ in said(text))


VARIABLE = "x1"
#: Words that can decide a verdict without being on a list.
TELLING = re.compile(r"[^\x00-\x7f]|error|exception|^x+$|^z+$|^0$")
REPEATED = re.compile(r"\b(\w{2,})(?: \1){2}|(\w+ \w+)(?: \2){2}|[xz]+(?: [xz]+){2}|(?:asdf|qwer|jkl|qwerty|zxcv)(?: (?:asdf|qwer|jkl|qwerty|zxcv)){2}")
#: Letters of neighbouring keys.
KEYS = frozenset("asdf qwer jkl qwerty zxcv".split())


def repeats(message: str) -> bool:
    """Whether ``REPEATED`` finds something.  It is slow, and asks for a word that stands again next or next but one, or for
    one of such letters."""
    w = message.split(" ")
    if any(map(eq, w, w[1:])) or any(map(eq, w, w[2:])) or not KEYS.isdisjoint(w) or ((" x" in message or " z" in message) and not all(x.strip("xz") for x in w)):
        return bool(REPEATED.search(message))
    return False


def masked(message: str) -> str:
    """A message with the words that no rule asks for as variables.  Whether words are said again and again hangs on every word,
    so a message with such words stays whole."""
    if repeats(message):
        return message
    return " ".join(map(_masked_word, message.split(" ")))


@lru_cache(maxsize=200_000)
def _masked_word(word: str) -> str:
    return word if word in CONSTANT or word in LOREM or TELLING.search(word) else VARIABLE


def latin(text: str) -> str:
    """Look-alike letters of other scripts in words with Latin letters made Latin."""
    return text if text.isascii() else WORDS.sub(lambda m: m[0] if m[0].isascii() or not re.search("[a-zA-Z]", m[0]) else m[0].translate(LOOKALIKES), text)


@lru_cache(maxsize=200_000)
def judge(template: str) -> str | None:
    """script, error, filler, or None for a template with content."""
    for kind, rule in RULES:
        if rule.search(template):
            return kind
    words = template.split(" ")
    if VARIABLE not in words and REPETITION.search(template):
        return "filler"
    lorem = sum(w in LOREM for w in words)
    if lorem >= 4 and lorem >= 0.7 * len(words):
        return "filler"
    return None


def unknown(form: str) -> float:
    """The share of variables among a form's words; words of other scripts that the classifier does not know are variables."""
    w = form.split(" ")
    return w.count(VARIABLE) / len(w)


class Leaf:
    """The templates of one leaf.  A message joins the first template with the rules' same verdict that agrees with it enough;
    messages come in order, so that templates hang on the messages alone."""

    def __init__(self) -> None:
        self.templates: list[tuple[str | None, list[str]]] = []
        self.members: list[tuple[str, int]] = []

    def add(self, message: str) -> None:
        verdict, words = judge(masked(message)), message.split(" ")
        for k, (kind, template) in enumerate(self.templates):
            if kind == verdict and len(template) == len(words):
                both = sum(a == b != VARIABLE for a, b in zip(template, words))
                either = sum(a != VARIABLE or b != VARIABLE for a, b in zip(template, words))
                if both >= AGREE * either:
                    self.templates[k] = kind, [a if a == b else VARIABLE for a, b in zip(template, words)]
                    self.members.append((message, k))
                    return
        self.members.append((message, len(self.templates)))
        self.templates.append((verdict, words))

    def verdicts(self, classifier: verdicts.Classifier | None) -> Iterator[tuple[str, str]]:
        """Messages with a verdict: that of the rules on their template, else the classifier's."""
        kinds = [kind or (classifier.kind(" ".join(template)) if classifier else None) for kind, template in self.templates]
        for message, k in self.members:
            if self.templates[k][0] or (kinds[k] and unknown(classifier.plain(message)) <= UNKNOWN):
                yield message, kinds[k]


def judged(batches: Iterable[pd.DataFrame], classifier: verdicts.Classifier | None = None) -> Iterator[pd.DataFrame]:
    """Messages with a verdict, from a stream of messages in order of their leaves; one leaf is held at a time."""
    leaf, at = Leaf(), None
    for batch in batches:
        out: list[tuple[str, str]] = []
        for name, message in zip(batch.leaf, batch.message):
            if name != at:
                out += leaf.verdicts(classifier)
                leaf, at = Leaf(), name
            leaf.add(message)
        yield pd.DataFrame(out, columns=["message", "kind"])
    yield pd.DataFrame(list(leaf.verdicts(classifier)), columns=["message", "kind"])


def form(message: str, known: frozenset[str]) -> str:
    """A message with unknown words (names and the like, by far the most) as variables.  Whether words are said again and again
    hangs on every word, so a message with such words stays whole."""
    if repeats(message):
        return message
    return " ".join([w if w in known else _masked_word(w) for w in message.split(" ")])


def leaf_of(form_: str) -> str:
    w = form_.split(" ")
    return " ".join([str(len(w)), *[x for x in w if x != VARIABLE][:DEPTH]])


def labelled(forms: dict[str, int], known: frozenset[str]) -> list[tuple[str, str | None, float]]:
    """The templates of forms, given with how often each is said, as rows to fit a classifier on."""
    leaves: dict[str, Leaf] = defaultdict(Leaf)
    for f in sorted(forms):
        leaves[leaf_of(f)].add(f)
    rows: list[tuple[str, str | None, float]] = []
    for leaf in leaves.values():
        support: Counter[int] = Counter()
        for m, k in leaf.members:
            support[k] += forms[m]
        for k, (kind, template) in enumerate(leaf.templates):
            text = verdicts.plain(" ".join(template), known)
            if unknown(text) <= 2 * UNKNOWN:
                rows.append((text, kind, JUDGED_WEIGHT if kind else min(3.0, 1 + math.log(support[k]))))
    return rows


def fitted(batches: Iterable[pd.DataFrame], known: frozenset[str]) -> Iterator[pd.DataFrame]:
    """The model of each part, from a stream of forms with their counts in order of parts; one part is held at a time."""
    forms, at = {}, None
    for batch in batches:
        for part, message, count in zip(batch.part, batch.message, batch["count"]):
            if part != at and forms:
                yield verdicts.Classifier(labelled(forms, known), known).model()
                forms = {}
            at, forms[message] = part, count
    if forms:
        yield verdicts.Classifier(labelled(forms, known), known).model()


def known_words(spoken: DataFrame, documents: int) -> frozenset[str]:
    """The words in messages of enough documents, counted over all, and those of the list.  No more than words a document times
    ``PART / KNOWN_IN``."""
    words = F.array_distinct(F.flatten(F.transform("sentences", lambda m: F.split(m, " "))))
    docs = spoken.select(F.explode(words).alias("word")).groupBy("word").count()
    enough = docs.filter(F.col("count") >= max(KNOWN_IN, -(-documents * KNOWN_IN // PART)))
    return frozenset(r.word for r in enough.collect()) | {w for ts in verdicts.KNOWN.values() for t in ts for w in t.split(" ")}


def classify(forms: DataFrame, parts: int, known: frozenset[str]) -> verdicts.Classifier:
    """The classifier: the mean of the models of the parts, each of which is fitted by one task."""
    tasks = min(parts, 10_000)
    counts = forms.select("part", F.explode("own").alias("message")).groupBy("part", "message").count()
    parted = counts.repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part", "message")
    models = parted.mapInPandas(lambda batches: fitted(batches, known), verdicts.MODEL)
    return verdicts.Classifier.mean(models.groupBy("name", "word").agg(*(F.sum(k).alias(k) for k in verdicts.KINDS)).collect(), known)


def fit(texts: DataFrame) -> tuple[frozenset[str], verdicts.Classifier]:
    """The known words and the classifier, from all documents."""
    known, classifier, _ = read(texts)
    return known, classifier


def read(texts: DataFrame) -> tuple[frozenset[str], verdicts.Classifier, DataFrame]:
    """The known words, the classifier, and per document its forms (``own`` those of its sentences, one for each; ``more``
    others) and whether it has a slot.  Texts are taken apart once."""
    spark = texts.sparkSession
    at, to = fresh_path(spark, "messages"), fresh_path(spark, "forms")
    spoken = _written(texts.select("doc_id", F.xxhash64("doc_id", "text").alias("hash"), _messages().alias("_s")).select("doc_id", "hash", "_s.*"), at)
    documents = spoken.count()
    parts, known = max(1, round(documents / PART)), known_words(spoken, documents)
    forms = _written(spoken.select("doc_id", F.pmod("hash", F.lit(parts)).alias("part"), "slot", _forms(known).alias("_f")).select("doc_id", "part", "slot", "_f.*"), to)
    discard(spark, at)
    return known, classify(forms, parts, known), forms


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _messages() -> Column:
    """The messages of a text, those that are sentences apart, and whether one has a slot."""

    @F.pandas_udf("sentences array<string>, lines array<string>, slot boolean")
    def take_apart(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            found = list(said(t))
            sentences = {m for m, _, sentence in found if m and sentence}
            rows.append((sorted(sentences), sorted({m for m, _, _ in found if m} - sentences), any(s for _, s, _ in found)))
        return pd.DataFrame(rows, columns=["sentences", "lines", "slot"])

    return take_apart("text")


def _forms(known: frozenset[str]) -> Column:
    """Per document the forms of its sentences, one for each, and the other forms."""

    @F.pandas_udf("own array<string>, more array<string>")
    def to_forms(sentences: pd.Series, lines: pd.Series) -> pd.DataFrame:
        rows = []
        for ss, ls in zip(sentences, lines):
            own = [form(m, known) for m in ss]
            rows.append((sorted(own), sorted({form(m, known) for m in ls} - set(own))))
        return pd.DataFrame(rows, columns=["own", "more"])

    return to_forms("sentences", "lines")


def find_residue(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``kinds`` (sorted, of slot, script, error, filler) of documents in which such a message stands as the text
    or among it.

    NULL ids and NULL or empty texts are no residue.  Documents that only write about such things (in quotes, or in sentences
    that are not the notice itself) are left alone.
    """
    texts = documents.select("doc_id", "text").filter("doc_id is not null and text <> ''")
    _, classifier, forms = read(texts)
    slots = forms.filter("slot").select("doc_id", F.lit("slot").alias("kind"))
    spoken = forms.select("doc_id", F.explode(F.array_union("own", "more")).alias("message"))
    words = F.split("message", " ")
    path = F.slice(F.array_remove(words, VARIABLE), 1, DEPTH)
    leaves = spoken.select("message").distinct().withColumn("leaf", F.concat_ws(" ", F.size(words), path))
    found = cut(leaves.repartition("leaf").sortWithinPartitions("leaf", "message").mapInPandas(lambda batches: judged(batches, classifier), "message string, kind string"))
    size = found.agg(F.sum(F.length("message"))).first()[0] or 0
    kinds = spoken.join(F.broadcast(found) if size <= BROADCAST_CHARS else found.hint("merge"), "message").select("doc_id", "kind")
    return slots.unionByName(kinds).groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
