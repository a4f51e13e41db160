"""Defective prompt and response pairs (problem 3).

A multi-label linear classifier over hashed n-grams of the answer, of its end, and features of the pair, all of them plain
measures: counts, shares, likelihoods. It is trained on a bounded sample of pairs, taken as sound, and on truncated, copied,
swapped, refused and emptied versions of them; its thresholds are calibrated on held-out ones. It alone decides.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp, log1p

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions.text import id_key
from strataq.llm import wording as W
from strataq.llm.languages import LANGUAGES, SEEDS, Languages

DEFECTS = ["empty", "truncated", "refusal", "copy", "other_language"]
BITS = 16
#: Features of the pair, and n-grams of the answer's end, count so much against the n-grams of the whole.
DENSE, TAIL, GRAM = 4.0, 3.0, 1.0
# The word before an answer, in lower case.
LABELS = ("answer", "respuesta", "reponse", "réponse", "antwort", "resposta", "risposta", "antwoord", "odpowiedź", "svar")
LABEL = re.compile(r"\b(?:" + "|".join(LABELS) + r")\s*:")
#: Words that stand for nothing where an answer is expected.
NOTHING = re.compile(r"(?i)\b(?:null|none|nil|n/?a|empty|undefined|nan)\b")
SOLID = re.compile(r"[^\W_]")
DIGIT = re.compile(r"\d")
TOKENS = re.compile(r"\w+")
QUESTION = re.compile(r"#+ ?Question:\s*\n?(.*?)(?=\n\s*\n?#+ ?\w+:|\Z)", re.S | re.I)
DONT_KNOW = re.compile(r"(?i)^(?:i (?:don['’]?t|do not) know|no lo s[eé]|no s[eé]|unknown)[.!]?$")
STOP = re.compile(r"[.!?…。！？][\"'”’)\]*_`]*$")
BULLET = re.compile(r"^\s*(?:[-*•–]|\(?\w{1,3}[.)])\s+")
SPACE = " \t\r\n​﻿ "
# Words by which a speaker means itself.
SPEAKER = set("i me my mine we us our myself puedo podemos podré prefiero siento lamento debo me mi mis yo tengo soy estoy quiero deseo voy nosotros nuestra je j nous suis peux préfère moi dois ich mir mich wir eu posso prefiro desculpe nós tenho sou preferisco devo dispiace ik mij wij spijt".split())


@dataclass
class Pair:
    """``arguments``: those of one call, or of every call of the message."""

    question: str
    prompt: str
    content: str | None
    arguments: str | list[str] | None


@dataclass
class Answer:
    text: str
    dont_know: bool = False
    broken: bool = False
    structured: bool = False
    open_marks: int = 0
    value: bool = False  # a figure, a truth value or a list, as JSON has them


def leaves(x: object) -> Iterator[str]:
    """The scalars of a JSON value as texts, in order."""
    if isinstance(x, dict):
        for v in x.values():
            yield from leaves(v)
    elif isinstance(x, list):
        for v in x:
            yield from leaves(v)
    elif x is not None:
        yield str(x)


def answer_of(content: str | None, arguments: str | list[str] | None) -> Answer:
    """Text in the message comes first, then the arguments of all its calls."""
    if content is not None and SOLID.search(content):
        return Answer(content)
    calls = [arguments] if isinstance(arguments, str) else list(arguments) if arguments is not None else []
    calls = [c.strip() for c in calls if c and c.strip()]
    if not calls:
        return Answer(content or "")
    texts, out = [], Answer("", structured=True)
    for raw in calls:
        try:
            args = json.loads(raw)
            if isinstance(args, str):
                args = json.loads(args)
        except (ValueError, RecursionError):
            texts.append(raw)
            out.broken = True
            out.open_marks += max(0, raw.count("{") - raw.count("}")) + max(0, raw.count("[") - raw.count("]")) + raw.replace('\\"', "").count('"') % 2
            continue
        if not isinstance(args, dict):
            args = {"Answer": args}
        known, value = args.get("Dont_Know"), args.get("Answer")
        out.dont_know |= known is True or str(known).strip().lower() == "true" or (isinstance(value, str) and bool(DONT_KNOW.match(value.strip())))
        out.value |= value is not None and not isinstance(value, str) and value != [] and value != {}
        texts.append("\n".join(leaves(value)))
    out.text = "\n".join(t for t in texts if t)
    return out


def labels_in(low: str) -> list[tuple[int, int]]:
    """Where the labels of answers begin and end in a text in lower case."""
    out = []
    at = low.find(":")
    while at >= 0:
        before = low[max(0, at - 16) : at].rstrip()
        if before.endswith(LABELS) and (m := list(LABEL.finditer(low, max(0, at - 24), at + 1))):
            out.append(m[-1].span())
        at = low.find(":", at + 1)
    return out


def lowered(text: str) -> str:
    """In lower case, of the same length: a letter whose lower case is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


#: Answers of so many characters or more hold something in any case.
SHORT = 80


def solid_letters(low: str) -> int:
    """Letters and digits of an answer, without labels and words that stand for nothing; an answer that isn't short counts as SHORT."""
    if len(low) >= 4 * SHORT:
        return SHORT
    return min(SHORT, len(SOLID.findall(NOTHING.sub(" ", LABEL.sub(" ", low)))))


@lru_cache(maxsize=65_536)
def shape(token: str) -> str:
    """Runs of letters, capitals and digits as one sign each; marks as they are."""
    s = re.sub(r"\d+", "9", token)
    return re.sub(r"[a-zà-öø-ÿ]+", "a", re.sub(r"[A-ZÀ-ÖØ-Þ]+", "A", s))[:8]


def ending(text: str, labels: list[tuple[int, int]], structured: bool, broken: bool) -> tuple[tuple, list[float]]:
    """What the end of a text looks like (see ``ending_grams``), and its plain measures (the last seven of FEATURES, in order)."""
    s = text.rstrip(SPACE)
    if broken:
        return ("broken", s[-1:]), [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    value = s[labels[-1][1] :].strip() if labels else ""
    lines = (value if value else s).split("\n")
    last = lines[-1].strip()
    kind = ("V" if len(lines) == 1 else "R") if value else "E" if labels else "N"
    kind = "B" if kind == "N" and BULLET.match(last) else kind  # an item of a list
    words = last.split()
    end = "" if not s else "." if STOP.search(s, max(0, len(s) - 6)) else "9" if s[-1].isdigit() else "a" if s[-1].isalpha() else s[-1]
    dots = s.endswith(("...", "…"))
    word = words[-1] if words else ""
    before = words[-2] if len(words) > 1 else ""
    commas = last.count(",")
    look = (f"J{kind}" if structured else kind, end, min(len(words), 7), shape(word) if DIGIT.search(word) else word.lower(), shape(word), "9" if DIGIT.search(before) else before.lower(), min(commas, 4), dots)
    fields = bare = 0.0
    if len(lines) > 1:
        above = [x.strip() for x in lines[:-1] if x.strip()]
        fields = max((x.count(",") for x in above), default=0)
        bullets = [x for x in above if BULLET.match(x)]
        bare = sum(not STOP.search(x) for x in bullets) / len(bullets) if bullets else 0.0
    is_open = float(bool(s) and end != "." and not value and not structured)
    marks = (last.count("(") > last.count(")")) + last.count('"') % 2 + (last.count("“") > last.count("”"))
    list_open = is_open * bare * bool(bare and BULLET.match(last))
    return look, [float(end == "."), float(dots), float(bool(value)), is_open - list_open, list_open, max(0, fields - commas) / 3 if fields > 1 else 0.0, min(marks, 2) / 2]


def ending_grams(look: tuple) -> list[str]:
    """N-grams of the end of a text: its kind with the length, last words, shape, commas and last sign."""
    if look[0] == "broken":
        return ["broken", f"broken{look[1]}"]
    kind, end, n, clue, sign, before, commas, dots = look
    return [f"{kind}{end}", f"{kind} {n}", f"{kind} w {clue}", f"{kind} s {sign}", f"{kind} b {before} {clue}", f"{kind} {n} {sign}", f"{kind} c {commas} {sign}", f"{kind} d {dots}"]


@lru_cache(maxsize=8192)
def asked_words(question: str) -> tuple[list[str], frozenset[str]]:
    words = TOKENS.findall(question.lower())
    return words, frozenset(words)


#: Length of the pieces by which an answer is looked up in its prompt.
PIECE = 24


def taken_from(low: str, prompt: str) -> tuple[float, int]:
    """(the share of the answer's pieces that stand in the prompt, how many don't)."""
    pieces = [low[i : i + PIECE] for i in range(0, max(1, len(low) - PIECE + 1), PIECE)]
    missing = sum(p not in prompt for p in pieces)
    return 1 - missing / len(pieces), missing


FEATURES = [
    "void", "left", "dont_know", "void_unknown", "structured", "value", "broken", "open_marks", "few_words", "inside", "recall", "echo", "extra", "cover", "prompt_echo", "value_new", "spoken", "speaker", "speaker_end", "adds",
    "gap", "gap_per_word", "same", "few_spoken", "stop", "dots", "labelled", "open", "list_open", "row_gap", "marks",
]
LANGUAGE_AT = FEATURES.index("gap")


class Words(dict):
    """From a word to its number; a new one gets its hash and its scores."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        x = self.lexicon
        if k >= len(x.hash):
            x.hash = np.concatenate([x.hash, np.zeros_like(x.hash)])
            x.scores = np.concatenate([x.scores, np.zeros_like(x.scores)])
        x.hash[k] = xxhash.xxh32_intdigest(word.encode("utf-8", "replace"))
        x.scores[k] = x.languages.word(word)
        return k


class Endings(dict):
    """From the look of an ending to the buckets of its n-grams."""

    def __missing__(self, look: tuple) -> list[int]:
        self[look] = ks = [xxhash.xxh32_intdigest(g.encode("utf-8", "replace"), 7) >> (32 - BITS) for g in ending_grams(look)]
        return ks


class Lexicon:
    """A word's hash and language scores, and the buckets of endings; remembered, as most texts share their words."""

    def __init__(self, languages: Languages) -> None:
        self.languages = languages
        self.hash = np.zeros(4096, np.uint32)
        self.scores = np.zeros((4096, len(LANGUAGES)), np.float32)
        self.words, self.endings = Words(self), Endings()

    def room(self) -> None:
        """Bounded memory, whatever the vocabulary; called between batches."""
        if len(self.words) > 500_000 or len(self.endings) > 500_000:
            self.words.clear()
            self.endings.clear()

    def ids(self, words: list[str]) -> list[int]:
        return list(map(self.words.__getitem__, words))


@dataclass
class Coded:
    """Pairs as numbers: dense features, and the buckets of the answers' n-grams and endings, one after the other."""

    dense: np.ndarray
    grams: np.ndarray
    gram_of: np.ndarray
    tails: np.ndarray
    tail_of: np.ndarray


def encode(pairs: list[Pair], lexicon: Lexicon) -> Coded:
    lexicon.room()
    dense, ids, sizes, spoken_at, lengths, tails, tail_sizes, asked = [], [], [], [], [], [], [], []
    for p in pairs:
        a = answer_of(p.content, p.arguments)
        text = a.text
        low = lowered(text)
        labels = labels_in(low)
        words = TOKENS.findall(low)
        left = solid_letters(low) if len(words) < 12 else SHORT
        void = 1 / (1 + left)
        question, in_question = asked_words(p.question)
        value = text[labels[-1][1] :].strip() if labels else ""
        value_new = float(bool(value) and not in_question.issuperset(TOKENS.findall(value.lower())))
        n = len(words) - (len(TOKENS.findall(low[labels[0][0] :])) if labels else 0) or len(words)
        said = words[:n]
        within = sum(map(in_question.__contains__, said))
        extra = n - within
        inside = within / n if n else 0.0
        recall = len(in_question.intersection(said)) / len(in_question) if in_question else 0.0
        echo = inside * recall * exp(-extra / 3)
        cover = prompt_echo = 0.0
        if n and p.prompt and not value_new:  # what adds a value of its own is no copy, whatever it repeats
            cover, missing = taken_from(low[: labels[0][0]].strip() if labels and labels[0][0] > 0 else low.strip(), p.prompt.lower())
            prompt_echo = cover * exp(-missing / 2) * min(1.0, n / 8)
        end_words = words[-40:] if len(words) > 40 else words
        first = not SPEAKER.isdisjoint(words)
        look, measures = ending(text, labels, a.structured, a.broken)
        adds = max(value_new, float(a.value))
        dense.append([
            void, log1p(left) / 4.4, float(a.dont_know), void * (not a.dont_know), float(a.structured), float(a.value), float(a.broken), min(a.open_marks, 3) / 3, float(len(words) < 8), inside, recall,
            echo * (1 - value_new), log1p(extra) / 4, cover, prompt_echo * (1 - value_new), value_new, min(n, 60) / 60, float(first), float(first and not SPEAKER.isdisjoint(end_words)), adds, 0.0, 0.0, 0.0, 0.0, *measures,
        ])
        of = lexicon.ids(words)
        ids.extend(of)
        sizes.append(len(of))
        spoken_at.append(len(of) if not labels or n == len(words) else n)
        lengths.append(labels[0][0] if labels and n < len(words) else len(low))
        buckets = lexicon.endings[look]
        tails.extend(buckets)
        tail_sizes.append(len(buckets))
        asked.append(p.question)
    x = np.array(dense, dtype=np.float64).reshape(len(pairs), len(FEATURES))
    ids_, sizes_ = np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64)
    of = np.repeat(np.arange(len(pairs)), sizes_)
    _add_languages(x, ids_, sizes_, np.array(spoken_at, dtype=np.int64), np.array(lengths), asked, lexicon)
    grams, gram_of = _word_grams(ids_, of, lexicon.hash)
    return Coded(x, grams, gram_of, np.array(tails, dtype=np.int64), np.repeat(np.arange(len(pairs)), tail_sizes))


def _word_grams(ids: np.ndarray, of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, of pairs of words and of pairs with a word between, and the row that each is of."""
    h = hashes[ids].astype(np.uint64)
    out, rows = [h >> np.uint64(32 - BITS)], [of]
    for gap, (a, b) in ((1, (0x9E3779B1, 0x85EBCA77)), (2, (0xC2B2AE3D, 0x27D4EB2F))):
        if len(ids) > gap:
            same = of[gap:] == of[:-gap]
            mixed = (h[:-gap] * np.uint64(a) + h[gap:] * np.uint64(b)) & np.uint64(0xFFFFFFFF)
            mixed = ((mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x2C1B3C6D)) & np.uint64(0xFFFFFFFF)
            out.append((mixed >> np.uint64(32 - BITS))[same])
            rows.append(of[gap:][same])
    return np.concatenate(out).astype(np.int64), np.concatenate(rows)


def _add_languages(x: np.ndarray, ids: np.ndarray, sizes: np.ndarray, spoken: np.ndarray, lengths: np.ndarray, asked: list[str], lexicon: Lexicon) -> None:
    """How much likelier the prose before any label is in another language than in that of the question."""
    n = len(sizes)
    if not n:
        return
    starts = np.cumsum(sizes) - sizes
    scores = np.zeros((n, len(LANGUAGES)), np.float32)
    full = np.flatnonzero(spoken)
    if len(full):  # the prose of a row is the first of its words; every other sum is over the rest up to the next row
        edges = np.stack([starts[full], starts[full] + spoken[full]], axis=1).ravel()
        padded = np.concatenate([lexicon.scores[ids], np.zeros((1, len(LANGUAGES)), np.float32)])
        scores[full] = np.add.reduceat(padded, edges, axis=0)[::2]
    known: dict[str, tuple[int, float]] = {}
    for q in set(asked):
        s = np.sum(lexicon.scores[lexicon.ids(asked_words(q)[0])], axis=0) if q else np.zeros(len(LANGUAGES))
        ranked = np.sort(s)
        known[q] = int(np.argmax(s)), float(np.tanh((ranked[-1] - ranked[-2]) / 6))
    mine = np.array([known[q][0] for q in asked])
    sure = np.array([known[q][1] for q in asked])
    own = scores[np.arange(n), mine]
    rest = scores.copy()
    rest[np.arange(n), mine] = -np.inf
    lead = rest.max(axis=1) - own  # above 0: another language is likelier
    said = np.maximum(spoken, lengths // 6 * (spoken > 0))  # some scripts put no spaces between words
    x[:, LANGUAGE_AT] = sure * np.tanh(np.maximum(lead, 0) / 12)
    x[:, LANGUAGE_AT + 1] = sure * np.clip(lead / np.maximum(1, spoken), 0, 3) / 3 * np.minimum(1.0, said / 6)
    x[:, LANGUAGE_AT + 2] = np.tanh(np.maximum(-lead, 0) / 12)
    x[:, LANGUAGE_AT + 3] = said < 5


def _length(n: np.ndarray) -> np.ndarray:
    """By what the weights of n n-grams are divided: its root, so that all have unit length together, and its share in long answers."""
    return np.maximum(np.sqrt(np.maximum(1, n)), n / 20)


@dataclass
class Model:
    """weights: (2**BITS, 5) of the n-grams. dense: (features + 1, 5), the last row being the intercept. thresholds: of the logit."""

    weights: np.ndarray
    dense: np.ndarray
    thresholds: np.ndarray
    languages: Languages

    def logits(self, c: Coded) -> np.ndarray:
        out = DENSE * c.dense @ self.dense[:-1] + self.dense[-1]
        for ids, of, scale in ((c.grams, c.gram_of, GRAM), (c.tails, c.tail_of, TAIL)):
            n = np.bincount(of, minlength=len(out))
            sums = np.stack([np.bincount(of, self.weights[ids, k], minlength=len(out)) for k in range(len(DEFECTS))], axis=1)
            out = out + scale * sums / _length(n)[:, None]
        return out


def decide(model: Model, c: Coded) -> list[str | None]:
    """The defect with the greatest logit above its threshold."""
    if not len(c.dense):
        return []
    margins = model.logits(c) - model.thresholds
    best = margins.argmax(axis=1)
    return [DEFECTS[k] if m > 0 else None for k, m in zip(best, margins[np.arange(len(best)), best], strict=True)]


def classify(model: Model, pairs: list[Pair]) -> list[str | None]:
    return decide(model, encode(pairs, Lexicon(model.languages)))


BROKEN_OFF = re.compile(r"(?<=\w\.) ")


def cut_short(text: str, r: random.Random) -> str | None:
    """A text broken off within a sentence of its prose, or within a row of its last value; None if it has no place for that."""
    labels = labels_in(lowered(text))
    if labels and r.random() < 0.3:
        rows = text[labels[-1][1] :].rstrip().split("\n")
        if rows[-1].count(",") >= 2:
            last = rows[-1]
            k = r.randrange(1, last.rindex(",") + 1)
            return text[: len(text.rstrip()) - len(last) + k]
    prose = text[: labels[0][0]].rstrip() if labels else text.rstrip()
    dots = [m.start() for m in BROKEN_OFF.finditer(prose) if ABBREVIATED.search(prose[: m.start()])]
    if dots and r.random() < 0.15:  # after an abbreviation
        return prose[: r.choice(dots)]
    places = [k for k in range(12, len(prose) - 1) if prose[k - 1] not in ".!?:\n" and not (prose[k - 1] == " " and prose[k - 2] in ".!?:") and prose[k] not in ".!?"]
    if not places:
        return None
    out = prose[: r.choice(places)]
    if r.random() < 0.1:
        return out.rsplit(" ", 1)[0] + r.choice([" in Ord. No.", " Sec.", " of Art.", " under Sec.", " see Fig.", " in Ch.", " as Ord."])
    return r.choice([out, out, out + "\n", out.rsplit(" ", 1)[0] + "...", out.rstrip() + "…"])


# Abbreviations that are followed by a capital.
ABBREVIATED = re.compile(r"(?i)(?:^|\W)(?:art|sec|ord|no|ch|fig|mr|mrs|dr|subd)\.$")


def sentences_of(text: str) -> list[str]:
    """The whole sentences of a text."""
    parts = re.split(r"(?<=[.!?])\s+(?=[^\W\d_a-zà-ÿ]|[¿¡\"“])", text)
    return [s for s in parts if s.endswith((".", "!", "?")) and not ABBREVIATED.search(s)]


def synthetic(p: Pair, others: list[Pair], r: random.Random, languages: Languages) -> list[tuple[Pair, str]]:
    """Defective versions of a sound pair, and sound ones (no defect) that know no answer, quote, list or tell of others who decline."""
    out: list[tuple[Pair, str]] = []
    a = answer_of(p.content, p.arguments)
    text = a.text
    raw = p.arguments if isinstance(p.arguments, str) else (p.arguments[0] if p.arguments is not None and len(p.arguments) else None)
    by_call = p.content is None

    def put(t: str) -> Pair:
        return Pair(p.question, p.prompt, None, json.dumps({"Dont_Know": r.random() < 0.5, "Answer": t})) if by_call else Pair(p.question, p.prompt, t, None)

    language = LANGUAGES[int(languages.text(p.question).argmax())] if p.question else "en"
    if by_call:
        out.append((Pair(p.question, p.prompt, None, r.choice(['{"Dont_Know":false}', '{"Dont_Know": false, "Answer": ""}', '{"Dont_Know": false, "Answer": null}', '{"Answer": null}', "", " ", "{}", '{"Dont_Know":false,"Answer":[]}', '{"Dont_Know":false,"Answer":" "}', '{"Dont_Know":false,"Answer":"N/A"}'])), "empty"))
        out.append((Pair(p.question, p.prompt, None, r.choice(['{"Dont_Know":true}', '{"Dont_Know": true, "Answer": null}', '{"Dont_Know":true,"Answer":""}', f'{{"Dont_Know":false,"Answer":{r.randrange(100)}}}', '{"Answer":"Yes"}', '{"Answer": "No"}'])), ""))
    else:
        out.append((Pair(p.question, p.prompt, r.choice(["", " ", "\n\n", "\t", "-", "--", '""', "ANSWER:", "ANSWER: \n", "Answer:\n\n", "**", "​", "```\n```", "...", "…", "null", "N/A", "ANSWER: N/A", "None.", None]), None), "empty"))
        label = r.choice(["ANSWER: ", "Answer: ", ""])
        out.append((Pair(p.question, p.prompt, label + r.choice(["YES", "NO", "Yes.", "No.", str(r.randrange(1000)), f"{r.randrange(99)} feet", "1e3", "I DON'T KNOW", "I don't know"]), None), ""))
    if not by_call and r.random() < 0.25:  # a value in rows
        rows = [f"{r.choice(['R', 'RS', 'A', 'MX', 'North Side ', 'Mill'])}{r.choice(['', '-1', '-12', '4A'])}, {r.randrange(1, 90_000)}, {r.choice(['Square Feet', 'Acres', 'Hectares'])}, {r.choice(['Yes', 'No'])}" for _ in range(r.randrange(1, 6))]
        front = " ".join(sentences_of(text)[:2]) + r.choice(["\n\n", "\n", " "]) + "ANSWER: "
        out.append((put(front + "\n".join(rows)), ""))
        k = r.randrange(1, rows[-1].rindex(","))
        out.append((put(front + "\n".join([*rows[:-1], rows[-1][:k]])), "truncated"))
    if by_call and raw and len(raw) > 6:
        cut = raw[: r.randrange(2, len(raw) - 1)]
        out.append((Pair(p.question, p.prompt, None, cut if cut.strip() else raw[:5]), "truncated"))
    elif len(text) > 40 and not by_call:
        for whole in (text, text if r.random() < 0.85 else "\n".join(f"- {s.lstrip('- ')}" for s in sentences_of(text))):
            cut = cut_short(whole, r)
            if cut and cut.strip():
                out.append((put(cut), "truncated"))
    lead = sentences_of(text) if not a.structured else []
    for n_lead in ([0], [0, 1, 1, 2]):
        some = " ".join(r.sample(lead, min(len(lead), r.choice(n_lead))))
        says, tail = (W.make(W.REFUSAL_EN, r), W.TAIL_EN) if language == "en" else (W.make(W.REFUSAL_ES, r), W.TAIL_ES) if language == "es" or r.random() < 0.5 else (W.make(W.REFUSAL_OTHER, r), W.TAIL_EN)
        out.append((put((some + " " + says).strip() + ("" if by_call else r.choice(tail))), "refusal"))
    if not by_call:
        for _ in range(2):
            unknown = W.make(W.UNKNOWN_ES if language == "es" else W.UNKNOWN_EN, r) + r.choice(W.UNKNOWN_TAIL)
            out.append((put((" ".join(lead[: r.choice([0, 1, 2, 3])]) + " " + unknown).strip()), ""))
        if lead and language == "en":
            out.append((put(" ".join([*lead[:1], W.make(W.NEAR_EN, r), *lead[1:]]) + r.choice(["", "\n\nANSWER: YES", "\nANSWER: NO"])), ""))
            quote = " ".join(r.choice([t for k, t in SEEDS.items() if k != language]).split()[: r.randrange(3, 9)])[:48]
            out.append((put(" ".join([*lead[:2], f'An old note says "{quote}" beside the table.', *lead[2:]])), ""))
        if len(lead) > 2 and r.random() < 0.6:
            mark, stops = r.choice(["- ", "- ", "* ", "• "]), r.random() < 0.6
            some = r.sample(lead, r.randrange(2, len(lead) + 1))
            out.append((put("\n".join(mark + (s if stops else s.rstrip(".")) for s in some)), ""))
        if lead and r.random() < 0.6:  # whole sentences, whichever comes last
            some = r.sample(lead, r.randrange(1, len(lead) + 1))
            out.append((put(r.choice([" ", " ", "\n", "\n- "]).join(some)), ""))
    if p.question:
        q = p.question
        words = q.split()
        k = r.randrange(len(words)) if words else 0
        dropped = " ".join(words[:k] + words[k + 1 :])
        swapped = " ".join(words[:k] + words[k : k + 2][::-1] + words[k + 2 :])
        out.append((put(r.choice([q, q, q.upper(), q.lower(), q.rstrip("?."), f"{q}\n{q}", f"The question is: {q}", f"Question: {q}", f"Q: {q}", f"{q}\n\nANSWER: {q}", dropped, swapped, q + " ??", p.prompt, p.prompt.split("#Context:")[-1].strip()])), "copy"))
        if lead and not by_call:  # what repeats the question and goes on is no copy
            out.append((put(f"{r.choice(['The question is: ', 'Question: ', ''])}{q} {' '.join(lead)}" + r.choice(["", "\n\nANSWER: NO"])), ""))
            out.append((put(f"{r.choice(['The question is: ', ''])}{q}\n\nANSWER: {r.choice(['YES', 'NO', '12', 'I DON’T KNOW'])}"), ""))
        away = [o for o in (r.choice(others) for _ in range(4)) if o.content and len(o.content) > 40 and LANGUAGES[int(languages.text(o.content).argmax())] != language]
        foreign = [t for k, t in SEEDS.items() if k != language]
        close = [SEEDS[k] for k in ("es", "fr", "de", "pt", "it", "en") if k != language]
        some = r.choice([r.choice(foreign), r.choice(close)])
        parts = sentences_of(some) or [some]
        some = " ".join(r.sample(parts, min(len(parts), r.choice([1, 2, 2, 3]))))
        if r.random() < 0.3:  # written without accents
            some = some.translate(str.maketrans("áéíóúñàèùâêîôûäöüçãõ", "aeiounaeuaeiouaoucao"))
        out.append((put(r.choice([o.content for o in away] + [some]) + ("" if by_call else r.choice(["", "\n\nANSWER: NO", "\nANSWER: YES", "\n\nRESPUESTA: SÍ"]))), "other_language"))
        if p.content and len(lead) > 1 and language == "en":
            out.append((Pair(r.choice(sentences_of(r.choice(close))), p.prompt, p.content, None), "other_language"))
    return out


#: A pair of the sample whose logit comes so near to a threshold is not learned from.
DOUBT = 2.5


def train(sample: list[Pair], seed: int = 42, epochs: int = 6) -> Model:
    """One-vs-rest logistic regression on the sample and defective versions of its sound pairs.

    A first model, for which all of the sample is taken as sound, finds those of it that are defective. The second, which is kept,
    learns them as what they were found to be, so that it adapts to wording that no grammar has, leaves out the doubtful ones, and
    makes its versions of the others. Thresholds: for each defect the logit that parts its held-out pairs from all other held-out ones with fewest errors.
    """
    r = random.Random(seed)
    model = Model(np.zeros((1 << BITS, len(DEFECTS)), np.float32), np.zeros((len(FEATURES) + 1, len(DEFECTS))), np.zeros(len(DEFECTS)), Languages())
    if not sample:
        return model  # it flags nothing
    languages = model.languages.adapt([t for p in sample for t in (p.question, p.content or "")])
    lexicon = Lexicon(languages)
    own = np.full(len(sample), -1)
    for turn in range(2):
        sound = [p for p, k in zip(sample, own, strict=True) if k == -1]
        made = [(q, y) for p in (sound if turn else sound[::3]) for q, y in synthetic(p, sound, r, languages)]
        c = encode([*sample, *(q for q, _ in made)], lexicon)
        labels = np.concatenate([own, np.array([DEFECTS.index(y) if y else -1 for _, y in made], dtype=own.dtype)])
        y = (labels[:, None] == np.arange(len(DEFECTS))).astype(np.float64)
        sure = labels > -2
        held = (np.arange(len(labels)) % 5 == 0) & sure
        model = _fit(c, y, ~held & sure, epochs if turn else epochs // 2, languages, seed)
        z = model.logits(c)
        model.thresholds = np.array([_threshold(z[held, k], y[held, k]) for k in range(len(DEFECTS))])
        if turn == 0:
            margins = (z - model.thresholds)[: len(sample)]
            own = np.where(margins.max(axis=1) > 0, margins.argmax(axis=1), np.where(margins.max(axis=1) > -DOUBT, -2, -1))
    return model


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    if not (y == 1).any() or not (y == 0).any():
        return 0.0
    order = np.argsort(z)
    zs, ys = z[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(ys)]) + np.concatenate([np.cumsum((1 - ys)[::-1])[::-1], [0]])
    edges = np.concatenate([[zs[0] - 1], zs, [zs[-1] + 1]])
    least = np.flatnonzero(wrong == wrong.min())
    k = int(least[np.argmax(edges[least + 1] - edges[least])])  # the widest gap
    return float(np.clip((edges[k] + edges[k + 1]) / 2, -4.0, 4.0))


def _fit(c: Coded, y: np.ndarray, use: np.ndarray, epochs: int, languages: Languages, seed: int = 42, rows: int = 500, rate: float = 0.2) -> Model:
    """Adagrad on the logistic loss of all labels at once, over the rows in ``use``, so many at a time."""
    n, k = y.shape
    dense = np.hstack([DENSE * c.dense, np.ones((n, 1))])
    parts = []
    for ids, of, scale in ((c.grams, c.gram_of, GRAM), (c.tails, c.tail_of, TAIL)):
        size = np.bincount(of, minlength=n)
        parts.append((ids, of, (scale / _length(size))[of]))
    ids, of, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(of, kind="stable")
    ids, value = ids[order], value[order]
    sizes = np.bincount(of, minlength=n)
    ends = np.cumsum(sizes)
    w, v = np.zeros((1 << BITS, k)), np.zeros((dense.shape[1], k))
    gw, gv = np.full_like(w, 1e-4), np.full_like(v, 1e-4)
    weight = np.where(y == 1, len(y) / np.maximum(1, 4 * y.sum(axis=0)), 1.0) / rows
    shuffled = np.random.default_rng(seed)
    some = np.flatnonzero(use)
    for _ in range(epochs):
        shuffled.shuffle(some)
        for at in range(0, len(some), rows):
            mine = some[at : at + rows]
            take = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in mine])
            row, col, val = np.repeat(np.arange(len(mine)), sizes[mine]), ids[take], value[take]
            z = dense[mine] @ v + np.stack([np.bincount(row, w[col, j] * val, minlength=len(mine)) for j in range(k)], axis=1)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[mine]) * weight[mine]
            g = dense[mine].T @ err
            h = np.stack([np.bincount(col, err[row, j] * val, minlength=1 << BITS) for j in range(k)], axis=1)
            gv += g * g
            gw += h * h
            v -= rate * g / np.sqrt(gv)
            w -= rate * h / np.sqrt(gw)
    return Model(w.astype(np.float32), v, np.zeros(k), languages)


#: A key may be hot if it holds more than one in HOT_KEYS of the rows, so there are fewer than HOT_KEYS hot keys.
HOT_KEYS, HOT_ROWS = 10_000, 50_000
#: The training sample is drawn from so many batches; a scan of a batch reads only the row groups that hold it.
BATCHES = 40
KEY = ["batch_id", "_key"]


def answered(responses: DataFrame) -> DataFrame:
    """(batch_id, _key, record_id, choice_index, content, arguments) of every choice of a response; arguments are those of all its calls."""
    got = responses.where("response IS NOT NULL AND record_id IS NOT NULL").select("record_id", "batch_id", id_key(F.col("custom_id")).alias("_key"), F.posexplode("response.body.choices").alias("_pos", "_c"))
    calls = F.filter(F.transform("_c.message.tool_calls", lambda t: t["function"]["arguments"]), lambda t: t.isNotNull())
    index = F.coalesce("_c.index", "_pos").cast("long")
    return got.select(*KEY, "record_id", index.alias("choice_index"), F.col("_c.message.content").alias("content"), calls.alias("arguments"))


def asked(requests: DataFrame) -> DataFrame:
    """(batch_id, _key, prompt): the user's message of each request, the latest where it is repeated."""
    users = F.filter("body.messages", lambda m: F.lower(m["role"]) == "user")
    rows = requests.select("batch_id", id_key(F.col("custom_id")).alias("_key"), "sent_at", F.try_element_at(users, F.lit(-1))["content"].alias("prompt"))
    return rows.groupBy(*KEY).agg(F.max(F.struct("sent_at", "prompt")).alias("_r")).select(*KEY, F.col("_r.prompt").alias("prompt"))


@dataclass
class Layout:
    """What one narrow pass over the responses tells: hot keys with their salts, some batches, and the rows that these hold."""

    hot: list[tuple[str, str, int]]
    batches: list[str]
    rows: int


def layout(responses: DataFrame, least: int = HOT_ROWS) -> Layout:
    """Of ids alone. A key is hot if it holds more than ``least`` rows and more than one in HOT_KEYS of all."""
    ids = responses.where("batch_id IS NOT NULL").select("batch_id", id_key(F.col("custom_id")).alias("_key"))
    keys = ids.groupBy(*KEY).agg(F.count("*").alias("n"))
    batches = keys.groupBy("batch_id").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("batch_id"), "batch_id").limit(BATCHES)
    total = keys.agg(F.sum("n").alias("n"))
    null = F.lit(None).cast("string")
    few = keys.where(F.col("n") > least).orderBy(F.desc("n")).limit(HOT_KEYS)
    rows = few.select("batch_id", "_key", "n", F.lit("key").alias("kind")).unionByName(batches.select("batch_id", null.alias("_key"), "n", F.lit("batch").alias("kind"))).unionByName(total.select(null.alias("batch_id"), null.alias("_key"), "n", F.lit("all").alias("kind")))
    found = rows.collect()  # fewer than HOT_KEYS + BATCHES + 1 rows
    most = max(least, max((r["n"] or 0 for r in found if r["kind"] == "all"), default=0) // HOT_KEYS)
    hot = sorted((r["batch_id"], r["_key"], -(-r["n"] // most)) for r in found if r["kind"] == "key" and r["_key"] is not None and r["n"] > most)
    some = [r for r in found if r["kind"] == "batch"]
    return Layout(hot, [r["batch_id"] for r in some], sum(r["n"] for r in some))


def paired(requests: DataFrame, responses: DataFrame, hot: list[tuple[str, str, int]] = ()) -> DataFrame:
    """(record_id, choice_index, prompt, content, arguments) of every choice with a request; repeated rows are still in.

    Requests are one row per key before they meet the answers. The rows of hot keys meet apart, spread over salts, of which
    the request gets one copy each; that is fewer than 2 * HOT_KEYS copies in all.
    """
    cols = ["record_id", "choice_index", "prompt", "content", "arguments"]
    got = answered(responses)
    if not hot:
        return got.join(asked(requests), KEY).select(cols)
    keys = requests.sparkSession.createDataFrame(list(hot), "batch_id string, _key string, _salts int")
    few = F.broadcast(keys)  # fewer than HOT_KEYS rows
    cold = got.join(few, KEY, "left_anti").join(asked(requests), KEY).select(cols)
    wanted = requests.withColumn("_key", id_key(F.col("custom_id"))).join(F.broadcast(keys.select(*KEY)), KEY, "left_semi")
    copies = asked(wanted).join(few, KEY).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    spread = got.join(few, KEY).withColumn("_salt", F.pmod(F.xxhash64("record_id", "choice_index"), F.col("_salts")).cast("int")).drop("_salts")
    return cold.unionByName(spread.join(copies, [*KEY, "_salt"]).select(cols))


def question_of(prompt: str | None) -> str:
    """The text under the heading of the question; empty if there is none."""
    prompt = prompt or ""
    start = prompt.find("#Question:\n")
    if start >= 0:
        end = prompt.find("\n\n#", start)
        return prompt[start + 11 : end if end >= 0 else len(prompt)].strip()
    m = QUESTION.search(prompt) if "uestion" in prompt.lower() else None
    return m.group(1).strip() if m else ""


def training_sample(requests: DataFrame, responses: DataFrame, size: int, plan: Layout | None = None) -> list[Pair]:
    """At most ``size`` pairs of BATCHES batches, chosen by a hash of the record id; only these reach the driver."""
    plan = plan or layout(responses)
    if not plan.batches:
        return []
    within = F.col("batch_id").isin(plan.batches)
    share = min(1.0, 1.2 * size / max(1, plan.rows))
    some = responses.where(within & (F.pmod(F.xxhash64("record_id", F.lit(7)), F.lit(1 << 40)) < int((1 << 40) * share)))
    rows = paired(requests.where(within), some).dropDuplicates(["record_id", "choice_index"])
    rows = rows.orderBy(F.xxhash64("record_id"), "record_id", "choice_index").limit(size).collect()
    return [Pair(question_of(r["prompt"]), r["prompt"] or "", r["content"], r["arguments"]) for r in rows]


def defective_pairs(requests: DataFrame, responses: DataFrame, sample: int = 2000, seed: int = 42, model: Model | None = None) -> DataFrame:
    """(record_id, choice_index, defect) of every defective pair, each once.

    A pair is one choice of a response with its request; responses without a request, failed calls and rows with a null
    record_id give none. Prompts and answers meet in one shuffled equi-join on (batch_id, custom_id), hot keys apart and salted; whole
    texts are read, in Arrow batches. The classifier is trained on at most ``sample`` pairs and goes to the workers with the function: its
    size is fixed by BITS.
    """
    plan = layout(responses)
    model = model or train(training_sample(requests, responses, sample, plan), seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(model.languages)
        for pdf in batches:
            # Repeated rows have one key, so they lie side by side and are decided once.
            ids = pdf[["record_id", "choice_index", "content"]]
            pdf = pdf[~ids.duplicated()]
            pairs = [Pair(question_of(p), p or "", c, a) for p, c, a in zip(pdf["prompt"], pdf["content"], pdf["arguments"], strict=True)]
            pdf = pdf.assign(defect=decide(model, encode(pairs, lexicon)))
            yield pdf.loc[pdf["defect"].notna(), ["record_id", "choice_index", "defect"]]

    found = paired(requests, responses, plan.hot).mapInPandas(run, "record_id bigint, choice_index bigint, defect string")
    return found.groupBy("record_id", "choice_index").agg(F.min("defect").alias("defect"))
