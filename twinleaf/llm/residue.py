"""Problem 8: template residue, filler, error messages and script notices.

Message templates are mined with a fixed-depth prefix tree: messages are masked, led by their length and first words
to a leaf, and joined there to the template they agree with. Every message of every document enters the tree of its
partition; the documents keep the numbers of their templates. Equal templates of all trees are one, and each is
classified once: by the vocabulary of notices it is made of, by how its words stand, by the words that only stand in
filler throughout the corpus, and by the documents it occurs in. The verdicts are joined back to the documents.
Unfilled slots inside ordinary records are found apart, by the grammar of slots.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinleaf.llm.normalizing import consistent
from twinleaf.sources.tables import spread
from twinleaf.sources.work import written

ANY, OTHER = "<*>", "<?>"
DEPTH = 3
#: Least share of equal positions for a message to join a template of its leaf.
SIMILARITY = 0.6
#: Templates of one tree; beyond, its templates are handed over and a new tree begins.
TREE_SIZE = 200_000
#: Messages of a partition whose template is remembered; a repeated message is counted without being read again.
REMEMBERED = 100_000
#: Share of a notice's words that must be exceeded by those that notices are made of.
COVERED = 0.75
#: Share of a word's messages that are filler from which the word is one of filler, and least number of such messages.
FILLER_SHARE, FILLER_LEAST = 0.1, 5
#: Share of the filler templates that have such a word, and share of a template's words that must be such.
FILLER_COMMON, FILLER_MADE = 1e-4, 0.8
#: Documents of a template, nearly all of them otherwise notices, from which it counts as part of the notice.
BESIDE_LEAST, BESIDE_SHARE = 3, 0.9

_DIGIT = re.compile(r"\d")
_TAGS = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?>")
_SENTENCE = re.compile(r"[.!?。！？।]\s+|[。！？।]|\n\s*\n")
_PARAGRAPH = re.compile(r"\n\s*\n")
_WORD = re.compile(r"[^\W\d_]++(?!\d)(?:['’][^\W\d_]++)?|\b[0-9a-f]{6,}\b|\d++(?:[.,:/]\d++)*|[^\W\d_]+")

# Words by the part they play in a notice, lower case, several languages.
SCRIPT_WORDS = set("javascript script scripts cookies ecmascript".split())
ERROR_NOUNS = set("error erreur fehler errore erro ошибка traceback exception warning".split())
#: Words before an error noun that make it the name of an error.
ERROR_KINDS = set("internal server fatal unknown unexpected runtime application system network http critical database unhandled uncaught".split())
STATUS = set("http not found gone forbidden unauthorized service unavailable bad gateway request timeout internal server error too many requests".split())
THINGS = set(
    "page site website server link file document record session request access service account connection resource url "
    "address content article item viewer application gateway host right permission "
    "seite datei dokument sitzung zugriff dienst adresse document fichier lien serveur accès service "
    "página pagina sitio archivo documento enlace sesión servidor acceso pagina sito collegamento sessione accesso "
    "страница документ файл сервер доступ ссылка сессия you we i something".split()
)
STATES = set(
    "denied expired blocked removed deleted moved missing unavailable failed wrong cannot could couldn't can't unable not "
    "no off gone lost wandered exist exists unreachable invalid broken down restricted refused limited "
    "nicht gefunden verfügbar abgelaufen verweigert gesperrt non trouvée trouvé introuvable disponible plus expiré refusé "
    "encontrada encontrado encontró pudo caducado denegado bloqueado trovata trovato scaduta negato "
    "не найдена найден недоступен недоступна запрещён истекла".split()
)
#: What could not be done, where a notice says so.
OUTCOMES = set("shown opened displayed loaded delivered found read reached processed completed accessed saved sent connected verified".split())
PLEAS = set("sorry oops whoops oh désolé désolés entschuldigung hoppla lo sentimos spiacenti human robot captcha извините".split())
ACTS = set(
    "enable enabled activate active activer activez aktivieren sie einschalten turn switch switched allow allowed required need needs "
    "disabled on support supported depends habilite habilitar activar attiva attivare ative reload refresh retry try again later wait "
    "while verify verifying check checking sign log login back return contact report view read open opens opened opening show shown "
    "display displayed load loaded loading deliver delivered answer respond responded asked requested requesting looking went "
    "continue proceed complete update upgrade outdated old unsupported seconds minutes moment time id ref code error step empty buffer extract failed please owner "
    "veuillez merci afficher voir lire recharger bitte um anzuzeigen anzeigen angeforderte wurde laden später erneut versuchen "
    "para ver este abrir leer favor intente nuevo más tarde recargue per visualizzare ricarica "
    "включите включить обновите browser browsers navigateur navegador brauser neu браузер".split()
) | SCRIPT_WORDS | ERROR_NOUNS | ERROR_KINDS | STATUS | THINGS | STATES | OUTCOMES | PLEAS
#: Words that any running text of its language holds.
FUNCTION_WORDS = set(
    "the of and to in is that for with be by from a an it its this these those has have had been was were are at as or but if "
    "your our us my me they them who which will may can before after again too many him she he does did do must "
    "der die das und von den zu mit ist ein eine einer dem des auf im für ihr ihre ihren es wir "
    "le la les des du et que pour dans une un est par ce cette ces votre nous vous il elle n'est s'est l'a à au avec sur "
    "el los las y por con del una en su se al lo esta esta ha sido il lo gli e di che un una è stata "
    "и в на с по для что это к от".split()
)
#: Marks of running prose that filler never holds.
_PROSE = set("the of and to in is that for with shall be by from may not der die und von den zu mit ist nicht ein eine le la les des du et que pour dans une un est par el los las y por con del una su se".split())
# Parts of notices in scripts that don't part words.
SCRIPT_PARTS = "有効 启用 啟用 請啟用 请启用 تفعيل सक्षम เปิดใช้งาน".split()
ERROR_PARTS = "エラー 错误 خطأ त्रुटि ข้อผิดพลาด 見つかりません 找不到 无法 غير موجود नहीं मिला ไม่พบ".replace("غير موجود", "موجود").replace("नहीं मिला", "मिला").split()
FILLER_PARTS = "ダミーテキスト 示例文本 占位".split()
FILLER_PHRASES = (
    "lorem ipsum", "dolor sit amet", "dummy copy", "dummy text", "sample text", "placeholder text", "filler text",
    "text goes here", "your text here", "text will appear", "only here to fill", "to fill the page", "asdf asdf", "blindtext",
    "texte de remplissage", "faux texte", "texto de ejemplo", "texto de relleno", "texto simulado", "testo segnaposto",
    "blah blah", "foo bar baz", "текст рыба",
)
# Words of pseudo-Latin filler.
PSEUDO_LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua "
    "enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure "
    "reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident "
    "sunt culpa officia deserunt mollit anim est laborum".split()
)
MENU = set(
    "home help contact search imprint terms sign in my files login log out menu about privacy sitemap faq account "
    "accueil aide rechercher recherche mentions légales connexion startseite hilfe kontakt suche impressum agb "
    "anmelden inicio ayuda contacto buscar aviso legal acceder cookies".split()
)
_FILLER_WORDS = {w for p in FILLER_PHRASES for w in p.split()} | set("clause paragraph box text noch ersetzen bitte your this".split())
#: Words that a template keeps, since verdicts are made of them: so a message and its template have one verdict.
KEPT = ACTS | FUNCTION_WORDS | _PROSE | PSEUDO_LATIN | MENU | _FILLER_WORDS | {ANY}
_KEPT = {w: w for w in KEPT}

_NAME = r"[^\W\d_][\w]*(?:[ ._'’-][\w]+){0,5}"
# The shapes of unfilled slots, each behind the text that all of its kind hold. They are searched in
# unwrapped text, where a line break parts paragraphs; a slot has any length within its paragraph.
SLOTS = tuple(
    (mark, re.compile(shape))
    for mark, shape in (
        ("{{", r"\{\{[^{}\n]+\}\}"),
        ("{%", r"\{%[^{}\n]+%\}"),
        ("${", r"\$\{[^{}\n]+\}"),
        ("<%", r"<%[^<>\n]+%>"),
        ("*|", r"\*\|[^|*\n]+\|\*"),
        ("{", rf"\{{ ?{_NAME} ?\}}"),
        ("<<", r"<<[^<>\n]+>>"),
        ("[[", r"\[\[[^\[\]\n]+\]\]"),
        ("@@", r"@@[\w .-]+@@"),
        ("#", r"#[^\W\d_][A-ZÀ-ÝА-Я0-9_]{2,}#"),
        ("%", r"%[^\W\d_a-zà-ÿ][A-ZÀ-ÝА-Я0-9_]{2,}%"),
        ("__", r"(?<![\w_])__[^\W_][\w]*?[^\W_]__(?![\w_])"),
        ("[", r"\[\s*(?:[●•◆■○]|…|\.\.\.|_{2,})\s*\]"),
        ("XXXX", r"(?<![\w-])X{4,}(?![\w-])"),
    )
)
_ANGLE = re.compile(r"<([A-ZÀ-ÝА-Я][A-ZÀ-ÝА-Я0-9_ ]+)>")
_SQUARE = re.compile(r"\[([^\[\]\n]{2,})\]")
_GUILLEMET = re.compile(r"[«‹]([^\W\d_][\w]*(?:[ _][\w]+){0,2})[»›]")
_SLOT_NAMES = re.compile(
    r"date|datum|fecha|amount|betrag|montant|importe|address|anschrift|adresse|domicilio|party|parties|"
    r"vertragspartner|partei|partie|parte|signator|signataire|firmante|unterzeichn|client|name|nom\b|nombre|kunde|"
    r"governing.law|law|rechtswahl|droit|ley|company|firma|société|empresa|title|number|nummer|numéro|número|city|"
    r"\bort\b|ville|ciudad|place|insert|enter|here",
    re.I,
)
_SLOT_ACTS = re.compile(
    r"\b(?:insert|enter|tbc|tbd|tba|todo|fill in|complete|completed|confirm|bitte|ergänzen|eintragen|einsetzen|"
    r"einfügen|préciser|compléter|à compléter|insérer|saisir|por completar|completar|insertar|indicar|rellenar)\b",
    re.I,
)
_CLICK = re.compile(
    r"click (?:here|or tap)[^.\n]{0,20} to enter|klicken sie hier, um|cliquez ici pour (?:saisir|entrer)|"
    r"haga clic aquí para (?:escribir|introducir)|pulse aquí para (?:escribir|introducir)",
    re.I,
)
_CLICK_PARTS = ("to enter", "sie hier, um", "ici pour", "aquí para")
#: A text without any of these marks and words holds no slot.
_MARKS = ("{", "<", "[", "@@", "#", "%", "__", "XXXX", "«", "‹", "*|")
# Words of which the name of a field is made, none of them by itself a remark in running text.
_FIELD = set(
    "name first last full middle family given your company client customer recipient sender date address city street country "
    "email e-mail phone telephone number amount title signature position of the vorname nachname firma datum anschrift "
    "nom prénom société adresse nombre apellido empresa fecha".split()
)
_FIELD_LINKS = {"of", "the", "your"}
_CLICK_WORDS = ("click", "klicken", "cliquez", "haga", "pulse")
_HTML = set("HTML HEAD TITLE BODY DIV SPAN TABLE UL OL LI BR HR PRE FORM".split())


def _unwrapped(text: str) -> str:
    """``text`` with one blank for all white space within a paragraph, so that no slot is broken by the end of a line."""
    return "\n\n".join([" ".join(p.split()) for p in _PARAGRAPH.split(text)])


def has_slot(text: str) -> bool:
    """Whether ``text``, in the consistent form, holds an unfilled template field."""
    if not any(mark in text for mark in _MARKS) and not any(word in text.lower() for word in _CLICK_WORDS):
        return False
    text = _unwrapped(text)
    if any(mark in text and shape.search(text) for mark, shape in SLOTS):
        return True
    for m in _ANGLE.finditer(text) if "<" in text else ():
        if m.group(1) not in _HTML:
            return True
    for m in _SQUARE.finditer(text) if "[" in text else ():
        inside = m.group(1).strip()
        if _SLOT_ACTS.search(inside) or (inside.isupper() and _SLOT_NAMES.search(inside)):
            return True
        named = set(inside.lower().split())
        if inside[:1].isupper() and named <= _FIELD and named - _FIELD_LINKS:
            return True
    for m in _GUILLEMET.finditer(text) if "«" in text or "‹" in text else ():
        inside = m.group(1)
        if _SLOT_NAMES.search(inside) and len(inside) <= 24:
            return True
    low = text.lower()
    return any(x in low for x in _CLICK_PARTS) and bool(_CLICK.search(low))


def _parts(text: str) -> list[str]:
    """The sentences of the paragraphs of a text in the consistent form, lower case."""
    return _SENTENCE.split((_TAGS.sub("\n\n", text) if "<" in text else text).lower())


def _masked(part: str) -> list[str]:
    """The words of a message, with a wildcard for each number and code."""
    if not _DIGIT.search(part):
        return _WORD.findall(part)
    return [w if w.isalpha() or not _DIGIT.search(w) else ANY for w in _WORD.findall(part)]


def messages(text: str) -> list[list[str]]:
    """The messages of a document as masked words. ``text`` is in the consistent form."""
    return [words for part in _parts(text) if (words := _masked(part))]


class PrefixTree:
    """Fixed-depth prefix tree of message templates; a leaf holds the templates of its length and first words.

    Words that verdicts are made of stay in a template, so messages that differ in one have templates of their own; other
    words become a wildcard where messages differ.
    """

    def __init__(self) -> None:
        self.leaves: dict[tuple, list[list]] = {}
        self.size = 0

    def add(self, words: list[str]) -> list:
        """The template that ``words`` join: its words and its number, 0 while it has none."""
        size = len(words)
        # Messages of one leaf agree in their first words and in all the words that templates keep.
        key = (*words[:DEPTH], *map(_KEPT.get, words[DEPTH:]))
        leaf = self.leaves.get(key)
        if leaf is None:
            leaf = self.leaves[key] = []
        for template in leaf:
            held = template[0]
            same = sum(map(eq, held, words))
            if same == size:
                return template
            if same >= SIMILARITY * size:
                if same + held.count(OTHER) < size:
                    template[0] = [a if a == b else OTHER for a, b in zip(held, words)]
                return template
        made = [words, 0]
        leaf.append(made)
        self.size += 1
        return made


_COVER = ACTS | FUNCTION_WORDS | {ANY}
_FILLER_COVER = _FILLER_WORDS | FUNCTION_WORDS | {ANY}
#: A word of every filler phrase.
_FILLER_KEYS = set("lorem dolor dummy sample placeholder filler text fill asdf blindtext remplissage faux ejemplo relleno simulado segnaposto blah foo рыба".split())


def _covered(words: list[str]) -> float:
    return sum(map(_COVER.__contains__, words)) / len(words)


def _names_error(words: list[str]) -> bool:
    """Whether an error noun stands as the name of an error: first, before a number, or after the kind of error."""
    for k, w in enumerate(words):
        if w in ERROR_NOUNS or (w.endswith(("error", "exception")) and len(w) > 9):
            before, after = words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""
            if k == 0 or before in ERROR_KINDS or before == ANY or after == ANY:
                return True
    return False


def verdict(template: str) -> str | None:
    """What a template is by its words: ``error``, ``script``, ``filler``, ``menu``, ``tail`` (stands beside a notice), or none."""
    words = template.split(" ")
    held, n = set(words), len(words)
    if not template:
        return None
    if not held & _PROSE:
        # Pseudo-Latin, the same few words again, or words of one letter each.
        runs = [w for w in held if len(w) > 2 and w.isalpha() and w == w[0] * len(w)]
        if held & {"lorem", "ipsum"} or len(runs) > 1 or (n >= 4 and len(held) <= n / 2 and all(w.isalpha() and len(w) > 2 and w not in MENU for w in held)):
            return "filler"
        if n >= 4 and len(held & PSEUDO_LATIN) >= 0.6 * len(held) and any(len(w) > 4 for w in held & PSEUDO_LATIN):
            return "filler"
    if held & _FILLER_KEYS and any(p in template for p in FILLER_PHRASES) and sum(map(_FILLER_COVER.__contains__, words)) >= COVERED * n:
        return "filler"
    if not template.isascii():
        joined = "".join(words)
        if any(p in joined for p in FILLER_PARTS):
            return "filler"
        if "javascript" in joined and any(p in joined for p in SCRIPT_PARTS):
            return "script"
        if n <= 6 and any(p in joined for p in ERROR_PARTS):
            return "error"
    if held & MENU and all(w in MENU or w == ANY for w in words):
        return "menu"
    covered = _covered(words)
    if covered <= COVERED:
        return None
    if held & SCRIPT_WORDS and n >= 3:
        return "script"
    if held & {"browser", "navigateur", "navegador", "браузер"} and held & {"reload", "turn", "support", "enable", "update"}:
        return "script"
    if _names_error(words) or (all(w in STATUS or w == ANY for w in words) and held & {"found", "gone", "forbidden", "unauthorized", "unavailable", "gateway", "requests", "error"}):
        return "error"
    unable = held & {"cannot", "could", "couldn't", "can't"}
    in_state = held & THINGS and held & STATES and n > 1 and len(held & ACTS) >= 2
    if held & PLEAS or (held & OUTCOMES if unable else in_state):
        return "error"
    if covered == 1.0 and held & ACTS and n <= 12:
        return "tail"
    return None


_READ = ["kind", "id", "template", "doc_id", "slot", "ids"]


def _read_once(docs: DataFrame) -> DataFrame:
    """One pass over the texts: the templates of each partition's prefix tree, and the documents.

    Rows of kind ``t`` have ``id`` and ``template``; rows of kind ``d`` have ``doc_id``, ``slot`` and ``ids``, the templates of
    all messages, once each. The numbers tell partitions apart.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # a tree has no cycles, and going through its many small lists costs a tenth of the time
        try:
            yield from grown(batches)
        finally:
            gc.enable()

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 36
        tree = PrefixTree()
        templates: list[list] = []
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for d, raw in zip(batch["doc_id"], batch["text"]):
                text = consistent(raw)
                ids = set()
                for part in _parts(text):
                    at = known.get(part)
                    if at is None:
                        at = 0
                        if words := _masked(part):
                            template = tree.add(words)
                            if not template[1]:
                                number += 1
                                template[1] = number
                                templates.append(template)
                            at = template[1]
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[part] = at
                    if at:
                        ids.add(at)
                out.append(("d", None, None, d, has_slot(text), sorted(ids)))
            if tree.size >= TREE_SIZE:
                out += [("t", t[1], " ".join(t[0]), None, None, None) for t in templates]
                tree, templates, known = PrefixTree(), [], {}
            yield pd.DataFrame(out, columns=_READ)
        yield pd.DataFrame([("t", t[1], " ".join(t[0]), None, None, None) for t in templates], columns=_READ)

    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null and trim(text) <> ''")
    schema = "kind string, id long, template string, doc_id long, slot boolean, ids array<long>"
    return written(spread(rows, "doc_id").mapInPandas(read, schema), "residue")


@F.pandas_udf(T.StringType())
def _verdicts(templates: pd.Series) -> pd.Series:
    return pd.Series([verdict(t) for t in templates], dtype=object)


def _judged(once: DataFrame) -> DataFrame:
    """The templates that have a verdict, once each: ``template``, ``verdict``.

    A verdict comes from the template's own words or from the words of filler: a word is one of filler if a share of all
    templates it stands in are filler by their own words; a template that is mostly made of such words is filler. Only
    words that a share ``FILLER_COMMON`` of the filler has are asked about, so at most the words of a filler template, on
    average, over that share are sent out.
    """
    spark = once.sparkSession
    templates = once.where("kind = 't'").select("template").distinct()
    own = written(templates.withColumn("verdict", _verdicts("template")), "templates")
    filler = own.where("verdict = 'filler'")
    words = filler.select(F.explode(F.array_distinct(F.split("template", " "))).alias("word")).where(~F.col("word").isin(ANY, OTHER))
    least = max(FILLER_LEAST, FILLER_COMMON * filler.count())
    often = {r.word: r.n for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()}
    if not often:
        return own.where("verdict is not null")
    asked = spark.sparkContext.broadcast(frozenset(often))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for t in batch["template"]:
                held.update(asked.value.intersection(t.split(" ")))
        yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    total = own.select("template").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    learned = spark.sparkContext.broadcast(frozenset(r.word for r in total if often[r.word] >= FILLER_SHARE * r.n))

    @F.pandas_udf(T.StringType())
    def again(template: pd.Series, verdict: pd.Series) -> pd.Series:
        known, out = learned.value, []
        for t, v in zip(template, verdict):
            if v is None:
                held = set(t.split(" ")) - {ANY, OTHER}
                v = "filler" if len(held) >= 3 and len(held & known) >= FILLER_MADE * len(held) else None
            out.append(v)
        return pd.Series(out, dtype=object)

    return own.select("template", again("template", "verdict").alias("verdict")).where("verdict is not null")


def message_templates(docs: DataFrame) -> DataFrame:
    """The templates of notices, errors, menus and filler of all documents: ``template``, ``verdict``."""
    return _judged(_read_once(docs)).where("verdict is not null")


def template_residue(docs: DataFrame) -> DataFrame:
    """Documents that hold an unfilled slot or filler, or that consist of an error message or a script notice.

    Columns ``doc_id``, ``kind`` (``slot``, ``filler``, ``error``, ``script``; the first that applies, in this order).
    Menu words may stand around a message. Null, empty and blank texts and rows without id give no rows; a document given twice comes out
    once; extra columns are ignored. The templates are mined over all documents and judged once; every message of every
    document has the verdict of its template. A template without verdict whose documents are nearly all notices
    otherwise is taken as part of them.
    """
    once = _read_once(docs)
    read = once.where("kind = 'd'").select("doc_id", "slot", "ids").dropDuplicates(["doc_id"])
    slots = read.where("slot").select("doc_id", F.lit("slot").alias("kind"))
    templates = once.where("kind = 't'").select("id", "template")
    # What is small is written before it is joined, so that its size decides how.
    judged = written(templates.join(written(_judged(once), "judged"), "template").select("id", "verdict"), "verdicts")
    rest = read.where("not slot").select("doc_id", F.size("ids").alias("size"), F.explode("ids").alias("id"))
    held = rest.join(judged, "id")

    def has(kind: str) -> Column:
        return F.coalesce(F.max(F.col("verdict") == kind), F.lit(False)).alias(kind)

    kinds = (has("filler"), has("script"), has("error"))
    by_doc = written(held.groupBy("doc_id").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("known"), *kinds), "cases")
    said = by_doc.where("(script or error) and not filler").withColumn("kind", F.when(F.col("script"), "script").otherwise("error"))
    found = slots.unionByName(by_doc.where("filler").select("doc_id", F.lit("filler").alias("kind")))
    found = found.unionByName(said.where("known = size").select("doc_id", "kind"))

    # Notices with other messages in them: do those stand in notices only?
    half = said.where("known < size and known * 2 >= size").select("doc_id", "kind", F.col("size") - F.col("known"))
    half = written(half.toDF("doc_id", "kind", "open"), "half")
    left = written(rest.select("doc_id", "id").join(half, "doc_id").join(judged.select("id"), "id", "left_anti"), "left")
    if left.isEmpty():
        return found
    named = written(left.join(templates, "id").select("doc_id", "kind", "open", "template"), "named")
    here = named.groupBy("template").agg(F.count_distinct("doc_id").alias("notices")).where(F.col("notices") >= BESIDE_LEAST)
    ids = written(templates.join(here, "template").select("id", "template", "notices"), "asked")
    everywhere = read.select("doc_id", F.explode("ids").alias("id")).join(ids, "id")
    beside = everywhere.groupBy("template", "notices").agg(F.count_distinct("doc_id").alias("n")).where(F.col("notices") >= BESIDE_SHARE * F.col("n"))
    more = named.join(beside.select("template"), "template").groupBy("doc_id", "kind", "open").agg(F.count_distinct("template").alias("more"))
    return found.unionByName(more.where("more = open").select("doc_id", "kind"))
