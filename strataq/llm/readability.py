"""Reading level of documents (problem 7): classic formulas over the English prose that is left of any layout.

A text is cleared of markup, furniture, tables and headings, cut into sentences, and each run of sentences gets several grade
estimates, all from sentence length and syllable counts; their median is its grade. A document's band is the one that most of
its words demand.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from math import sqrt
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.session import cut

#: Upper grades of bands 1 to 3, school years; band 4 lies beyond. See ``fit_cuts`` for cuts fitted to labels.
CUTS = (5.5, 9.5, 13.5)
# Frequent function words.
FUNCTION_WORDS = {
    "en": "a the of and to in is for that be by as are with on or not this it an from at which shall may will must can you your has have was were if when who their they we our no any all but than there so what how before after until under only its been would such each please do does here he she us them could should into does did was every where there whether whom these those about over between above below per both either neither because against within without during since while although yet i me my mine am don doesn isn t s can cannot im ve ll just also".split(),
    "es": "a el la los las de del y en que un una por para con no se es al lo como más su sus o este esta entre cuando si sin sobre también ser son fue ha puede debe desde hasta todos antes donde quien".split(),
    "fr": "a le la les des du de et en un une que qui dans pour par sur avec au aux ne pas ce cette est sont il elle ou se son sa ses plus peut doit être nous vous d l où dont avant leur lorsque entre tout tous".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum kann muss oder vor zur darf wenn innerhalb".split(),
    "pt": "o a os as de do da dos das e em que um uma por para com não se é ao no na nos nas como mais seu sua ou este esta entre quando sem também ser são foi pode deve até pelo pela antes onde quem".split(),
    "it": "a il lo la i gli le di del della dei delle e in che un una per con non si è al come più suo sua o questo questa tra quando se anche essere sono può deve dal dalla nel nella".split(),
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als bij of uit door naar dan wordt worden kan moet deze dit maar nog tot over".split(),
}
ENGLISH_ENDINGS = re.compile(r"(?:tion|tions|ing|ment|ments|ity|ities|ly|ed|ness|ship|ary|ous|ful|ght|ures?|ards|ents|ates?)$")
FOREIGN_LETTERS = re.compile(r"[áéíóúñàâçèêëîïôùûäöüßãõ]")
VOTES: dict[str, dict[str, float]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        VOTES.setdefault(_w, {})[_lang] = 1.0

BLOCK_TAG = re.compile(r"(?i)</?(?:p|br|li|ul|ol|div|h[1-6]|tr|table|section|article|blockquote|body|html|head|title|hr|dd|dt|dl)\b[^>]*>")
CELL_TAG = re.compile(r"(?i)</?t[dh]\b[^>]*>")
TAG = re.compile(r"<[!/a-zA-Z][^<>]*>")
BULLET = re.compile(r"^\s*(?:[-*•–]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)])\s+")
FURNITURE = re.compile(r"(?i)^\W*page \d+(?: of \d+)?\W*$")
FILE_NAME = re.compile(r"^\S+\.[A-Za-z]\w{1,3}$")
LEADERS = re.compile(r"\.{4,}|(?:\. ){4,}|_{4,}")
HEADING = re.compile(r"(?i)^(?:(?:sec(?:tion|\.)?|§+|art(?:icle|\.)?|chapter|division|part|title)\s*[\dIVX]+[\d.\-]*[.,:]?|\d+(?:[.\-]\d+)+)\s*(?:part \d+:?)?\s*(?:[\w'-]+\s?){0,4}\.?$")
# Abbreviations whose stop ends no sentence.
ABBREVIATIONS = set("sec art ord no nos e.g i.e sq ft in st ave rd dr mr mrs ms fig ch vol etc approx inc vs para cf subd dept a.m p.m".split())
SHORT_WORD = re.compile(r"\b([A-Za-z]\.[A-Za-z]|[A-Za-z]{1,6})\.")
SENTENCE_END = re.compile(r"(?<=[.!?])[\"')”’\]]*\s+(?=[\"'(“‘\[]?[^\W_a-z])")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
LETTER = re.compile(r"[^\W\d_]")

# Hyphenation-style rules for counting syllables, in the order in which they apply.
VOWELS = re.compile(r"[aeiouy]+")
SILENT = re.compile(r"(?:[^laeiouy]es|[^aeiouytd]ed|[^aeiouyl]e|[aeiouy]le|[^aeiouy]ely|[^aeiouy]e(?:ful|less|ment|ments|ness))$")
SOUNDED = re.compile(r"(?:[sxz]|ch|sh|[cg])es$")
HIATUS = re.compile(
    r"i(?:a(?!n$|l$|ge)|o(?!n|us)|u)|[aeiou]ing$|ia[nl]$|[^tscgnl]ion|^lion|[^aeioucgstx]ious$|eo(?!n$|us|p)|(?<![qg])u(?:al|ous|ation|ate)|[^q]uary|creat|io[lr]|sm$|[^aeiouy]l(?:e|es|ed)$"
    r"|^re(?=act|en|in|af|ap|ali|ev|or|op)|scie|ciet|piet|priet|quie|die[tn]|[rdnl]ien[ct]|[^aeiou]ea$|[rl]ui[nd]|^theat|seum|poe|uity|[bcgt]re$|[nsf]u(?:ant|ine|en[ct])|herein|(?:r|x)iety"
)
LE = re.compile(r"[^aeiouy]l(?:e|es|ed)$|[bcgt]re$")
# Silent e within a word: before a compound's second part, or an ending that keeps it.
INNER = re.compile(
    r"[aeiouy]{1,2}[^aeiouywx]e(?=(?:thing|where|body|one|fore|by|after|in|with|of|upon|from|times?|work|land|house|side|way|walk|wise|line|light|yard|front|back|man|men|keep|owner|place|sale|guard|wide)(?:s|ing|r)?$)"
    r"|(?:here|there|where)(?=(?:by|after|in|with|of|upon|from|under|fore)$)|busin(?=ess)|efully$"
)
# One sound, as in special and partial.
SOFT = re.compile(r"[tc]ial(?:ly|ity)?$|[st]ian$")


@lru_cache(maxsize=200_000)
def syllables(word: str) -> int:
    """Vowel groups, less silent vowels at the end and within, plus vowels in hiatus. At least 1."""
    w = word.lower()
    n = len(VOWELS.findall(w))
    if LE.search(w):
        pass  # a consonant with l keeps its vowel
    elif SILENT.search(w) and not SOUNDED.search(w):
        n -= 1
    n += len([1 for m in HIATUS.finditer(w) if not LE.search(m.group())])
    if INNER.search(w):
        n -= 1
    if w.endswith(("gue", "que", "gues", "ques")):
        n -= 1
    if SOFT.search(w) and HIATUS.search(w) and not w.endswith(("strian", "trial")):
        n -= 1
    return max(1, n)


def votes(word: str) -> tuple[float, float]:
    """For English and for the other languages."""
    by = VOTES.get(word, {})
    english = by.get("en", 0.0)
    other = max((v for k, v in by.items() if k != "en"), default=0.0)
    if FOREIGN_LETTERS.search(word):
        other += 1.0
    elif not by and len(word) > 4 and ENGLISH_ENDINGS.search(word):
        english += 0.6
    return english, other


class WordFacts(dict):
    """word: (votes for English, votes for others, syllables, whether 3 or more, whether 1); remembered for most words."""

    def __missing__(self, word: str) -> tuple[float, float, int, int, int]:
        if len(self) > 500_000:  # bounded memory, whatever the vocabulary
            self.clear()
        low = word.lower()
        n = syllables(low)
        self[word] = facts = (*votes(low), n, int(n >= 3), int(n == 1))
        return facts


FACTS = WordFacts()


def prose_lines(text: str) -> list[str]:
    """Paragraphs and list items, without what is no prose."""
    if "<" in text:
        text = TAG.sub("", CELL_TAG.sub("\t", BLOCK_TAG.sub("\n\n", text)))
    if "&" in text:
        text = html.unescape(text)
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace(" ", " ").replace("​", "")
    out: list[str] = []
    open_line = ""

    def close() -> None:
        nonlocal open_line
        if open_line:
            out.append(open_line)
            open_line = ""

    for raw in text.split("\n"):
        line = raw.strip()
        if not line:
            close()
            continue
        if FURNITURE.match(line):
            continue
        item = BULLET.match(raw) if not raw[0].isalpha() or raw[1:4].find(".") >= 0 or raw[1:5].find(")") >= 0 else None
        body = raw[item.end() :].strip() if item else line
        cells = line.count("|") + line.count("\t") + line.count(";") + line.count(", ") + 1
        tokens = body.split()
        figures = sum(1 for t in tokens if not t[0].isalpha() and not LETTER.search(t))
        table = ("|" in line or "\t" in line) or (cells >= 4 and len(tokens) <= 2.6 * cells and line[-1] not in ".!?") or figures * 2 >= len(tokens)
        if table or LEADERS.search(line) or (len(tokens) == 1 and (not open_line or FILE_NAME.match(line))) or (len(line) < 80 and HEADING.match(line)):
            close()
        elif item:
            close()
            open_line = body
        elif not open_line and len(tokens) <= 4 and line[-1] not in ".!?":
            pass  # a heading in words
        else:
            open_line = f"{open_line} {line}" if open_line else line
    close()
    return out


def _without_stops(m: re.Match) -> str:
    word = m.group(1)
    return word.replace(".", "") + "․" if word.lower() in ABBREVIATIONS else m.group()


def sentences(line: str) -> list[list[str]]:
    safe = SHORT_WORD.sub(_without_stops, line) if "." in line else line
    return [w for s in SENTENCE_END.split(safe) if len(w := WORD.findall(s)) >= 3]


def grades(n_sentences: int, n_words: int, n_syllables: int, n_long: int, n_single: int) -> float:
    """The median of Flesch-Kincaid, Gunning fog, SMOG, FORCAST, Linsear Write and a grade from Flesch reading ease."""
    per, syl, long = n_words / n_sentences, n_syllables / n_words, n_long / n_words
    ease = 206.835 - 1.015 * per - 84.6 * syl
    linsear = (n_words - n_long + 3 * n_long) / n_sentences
    return median(
        [
            0.39 * per + 11.8 * syl - 15.59,
            0.4 * (per + 100 * long),
            1.043 * sqrt(30 * n_long / n_sentences) + 3.1291,
            20 - 15 * n_single / n_words,
            linsear / 2 if linsear > 20 else linsear / 2 - 1,
            (100 - ease) / 5.5 if ease > 45 else 10 + (45 - ease) / 7,
        ]
    )


#: Sentences are pooled to runs of at least so many words; those farther than FAR grades from the run's median count apart.
POOL, FAR = 60, 9.0
Counts = tuple[int, int, int, int, int]


def english_runs(text: str | None) -> Iterator[list[Counts]]:
    """Counts (sentences, words, syllables, words of three or more syllables, of one) of the English sentences, in pooled runs."""
    run: list[Counts] = []
    size = 0
    for line in prose_lines(text or ""):
        for words in sentences(line):
            n = len(words)
            english, other, n_syllables, n_long, n_single = map(sum, zip(*map(FACTS.__getitem__, words), strict=True))
            if english <= other or english < 0.08 * n:
                continue
            run.append((1, n, n_syllables, n_long, n_single))
            size += n
        if size >= POOL:
            yield run
            run, size = [], 0
    if run:
        yield run


def graded(run: list[Counts]) -> list[tuple[float, int]]:
    """(grade, words) of a run's main part and of each sentence far from it."""
    own = sorted((grades(*c), c) for c in run)
    half, middle = sum(c[1] for c in run) / 2, own[0][0]
    for g, c in own:
        middle = g
        half -= c[1]
        if half <= 0:
            break
    near = [c for g, c in own if abs(g - middle) <= FAR]
    sums = [sum(x) for x in zip(*near, strict=True)]
    return [(grades(*sums), sums[1]), *((g, c[1]) for g, c in own if abs(g - middle) > FAR)]


def grade_runs(text: str | None) -> tuple[list[float], list[int], int]:
    """The grades of a text's English runs, their words, and its English sentences."""
    grades_, words, n = [], [], 0
    for run in english_runs(text):
        n += len(run)
        for g, w in graded(run):
            grades_.append(g)
            words.append(w)
    return grades_, words, n


def profile(text: str | None, cuts: tuple[float, ...] = CUTS) -> tuple[float | None, int | None, int, int, list[int]]:
    """(grade, band, English words, English sentences, words by band); grade and band are None without an English sentence."""
    own, words, n = grade_runs(text)
    by = [0] * 4
    for g, w in zip(own, words, strict=True):
        by[sum(g > c for c in cuts)] += w
    total = sum(words)
    if not total:
        return None, None, 0, 0, by
    return sum(g * w for g, w in zip(own, words, strict=True)) / total, max(range(4), key=lambda b: by[b]) + 1, total, n, by


GRADED = "doc_id bigint, grades array<double>, words array<bigint>, english_sentences bigint"


def graded_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, grades, words, english_sentences): the grade of every run of English sentences and its words, empty without any.

    A map over (doc_id, text) alone, in Arrow batches; nothing is shuffled, and whole texts are read, once. Repeated rows give
    repeated rows. Other columns are not looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *grade_runs(t)) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "grades", "words", "english_sentences"])

    return documents.select("doc_id", "text").mapInPandas(run, GRADED)


def banded(graded: DataFrame, cuts: tuple[float, ...] = CUTS) -> DataFrame:
    """(doc_id, grade, band, english_words, english_sentences, words_by_band) of graded documents, all in the JVM."""
    edges = [F.lit(float("-inf")), *[F.lit(float(c)) for c in cuts], F.lit(float("inf"))]

    def within(low: Column, high: Column) -> Column:
        parts = F.zip_with("grades", "words", lambda g, w: F.when((g > low) & (g <= high), w).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, w: s + w)

    by = F.array(*[within(a, b) for a, b in zip(edges, edges[1:], strict=False)])
    weighted = F.aggregate(F.zip_with("grades", "words", lambda g, w: g * w), F.lit(0.0), lambda s, x: s + x)
    out = graded.select("doc_id", by.alias("words_by_band"), F.aggregate("words", F.lit(0).cast("bigint"), lambda s, w: s + w).alias("english_words"), "english_sentences", weighted.alias("_sum"))
    has = F.col("english_words") > 0
    out = out.withColumn("band", F.when(has, F.array_position("words_by_band", F.array_max("words_by_band"))))  # the first of equal ones
    return out.select("doc_id", F.when(has, F.col("_sum") / F.col("english_words")).alias("grade"), "band", "english_words", "english_sentences", "words_by_band")


def reading_levels(documents: DataFrame, cuts: tuple[float, ...] = CUTS) -> DataFrame:
    """One row per document: its grade and band, null without English prose (null or empty text, figures, other languages)."""
    return banded(graded_documents(documents), cuts)


def fitted_levels(documents: DataFrame, labels: DataFrame, sample: int = 2000) -> DataFrame:
    """``reading_levels`` with cuts fitted to the labels. Texts are read once: their grades are checkpointed, narrow rows."""
    graded = cut(graded_documents(documents))
    return banded(graded, fit_cuts(graded, labels, sample))


def fit_cuts(graded: DataFrame, labels: DataFrame, sample: int = 2000) -> tuple[float, ...]:
    """Cuts between the bands, fitted to the grades of at most ``sample`` labelled documents of ``graded_documents`` on which the raters agree.

    Only this bounded sample reaches the driver; a boundary without labels on both sides keeps its classic value.
    """
    agreed = labels.where("doc_id IS NOT NULL AND band IS NOT NULL").groupBy("doc_id").agg(F.min("band").alias("_band"), F.max("band").alias("_most"))
    agreed = agreed.where("_band = _most").select("doc_id", "_band").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = banded(graded.join(F.broadcast(agreed), "doc_id", "left_semi")).where("grade IS NOT NULL").join(F.broadcast(agreed), "doc_id")  # at most ``sample`` rows
    rows = rows.select("grade", "_band").collect()
    cuts = []
    for k, classic in zip((1, 2, 3), CUTS, strict=True):
        low, high = sorted(g for g, b in rows if b == k), sorted(g for g, b in rows if b == k + 1)
        if not low or not high:
            cuts.append(classic)
            continue
        places = sorted({*low, *high})
        between = [(a + b) / 2 for a, b in zip(places, places[1:], strict=False)] or [classic]
        wrong = {c: sum(g > c for g in low) / len(low) + sum(g <= c for g in high) / len(high) for c in between}
        best = [c for c in between if wrong[c] == min(wrong.values())]
        cuts.append((best[0] + best[-1]) / 2)
    return tuple(max(cuts[: i + 1]) for i in range(3))
