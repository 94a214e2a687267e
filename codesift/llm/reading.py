"""Reading level of documents on a scale fitted to rated ones.

Running prose is taken out of each text: code, tables, lists, quotes, headings,
signatures, links and markup are left aside.  Classic formulas (Flesch-Kincaid,
Gunning fog, SMOG, ARI, Coleman-Liau, LIX, FORCAST) give one grade each, from
sentence lengths and from syllables counted by hyphenation-style rules.  Each
grade is put on the raters' scale by a monotone fit over labelled documents;
the median of these estimates, cut at fitted thresholds, is the level.

The fit reads at most ``fit_rows`` labelled documents, a bound on what goes to
the driver; a document's label is the median of its raters.  All statistics of
the corpus cover every document.

Defined results: null, empty, non-English, mainly non-prose texts and texts of
fewer than 40 words of prose get no level.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 40
ESTIMATES = ("kincaid", "fog", "smog", "ari", "coleman", "lix", "forcast")
FEATURES = "doc_id BIGINT, words INT, " + ", ".join(f"{e} DOUBLE" for e in ESTIMATES)
LEVELLED = "doc_id BIGINT, level INT, score DOUBLE, words INT"

# Frequent function words of English, and of the other languages of the collection.
ENGLISH = frozenset("the of and to in is that it for was on are as with be at by this have from or had an they which you were her all she there would their we him been has when who will no more if out so up said what its about than into them can only other new some could time these two may then do first any my now such like our over me even most made after also did many before must through where much your way well down should because each just those how too little very make still own see work both between being under never same another know while last might us great off come since against go came right used take three don't not but a i run look ask try".split())
OTHERS = frozenset("der die das und nicht ist ein eine einen dem den des zu mit von auf für im wir sich auch nach bei aus wurde noch nur vor haben oder dass wie am bleibt ohne tritt bitte el la los las que de en un una para con por se del al como más pero su sus está antes hay sin cuando entre otra esta vacía le les et dans pour sur avec pas une est".split())
_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)")
_HTML = re.compile(r"<(?:!--.*?--|/?[A-Za-z][^<>\n]{0,300})>|&[a-z]+;|&#\d+;", re.S)
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)")
_URL = re.compile(r"(?:https?|ftp|mailto)://?\S+|\bwww\.\S+|\S+@\S+\.\w+")
_CODE_LINE = re.compile(r"^(?: {4,}|\t)|[{};]\s*$|^\s*(?:def|class|func|fn|import|from|const|let|var|return|package|use|pub|if|for|while|switch|case|export|#!|@\w|\$ |>>> )\b.*[=(){}:;]|^\s*[\w.]+\(.*\)\s*$|[\w\])]\s*(?::=|\+=|==|=>|->|=)\s*[\w\"'({\[]|^\s*(?://|#!|/\*|\*/|--\s*\w+$)")
# a line of code has one of these
_CODEY = re.compile(r"[={}();:]|^(?: {4,}|\t)|^\s*(?://|#!|/\*|\*/|--)|[-=]>")
_MARKS = re.compile("\\*\\*|~~|[\u200b-\u200f\u2060\u00ad\ufeff]")
_TABLE = re.compile(r"^\s*\|.*\|?\s*$|^\s*[-|:+\s=]{4,}$")
_LIST = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+(.*)$")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|={3,}|-{3,}|\*{3,}|Subject:|From:|To:|Date:|Re:|Cc:)", re.I)
_SIGNATURE = re.compile(r"^\s*(?:--\s*$|sent (?:by|from)\b|(?:best|kind) regards|cheers,|thanks,\s*$|signed-off-by|co-authored-by|reviewed-by)", re.I)
_WORD = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’-][A-Za-zÀ-ɏ]+)*|\d+(?:[.,]\d+)*")
_END = re.compile(r"[.!?…]+(?=[\s\"')\]]|$)")


def prose_of(text: str) -> tuple[str, int]:
    """(the running prose, one sentence end per line where marks are lost; words of the rest)."""
    text = text.replace("\r\n", "\n")
    body, rest = text, 0
    if "```" in text or "~~~" in text:
        body = _FENCE.sub("\n\n", text)
        rest = len(_WORD.findall(text)) - len(_WORD.findall(body))
    if "](" in body:
        body = _LINK.sub(r"\1", body)
    if "<" in body or "&" in body:
        body = _HTML.sub(" ", body)
    if "**" in body or "~~" in body or not body.isascii():
        body = _MARKS.sub("", body)
    kept: list[str] = []
    for line in body.split("\n"):
        line = line.rstrip("\r")
        if not line.strip():
            kept.append("")
            continue
        listed = _LIST.match(line)
        if _TABLE.match(line) or _HEADING.match(line) or _SIGNATURE.match(line):
            rest += len(_WORD.findall(line))
        elif line.lstrip().startswith(">"):
            continue  # somebody else's text
        elif listed and len(_WORD.findall(line)) < 8:
            rest += len(_WORD.findall(line))
        elif _CODEY.search(line) and _CODE_LINE.search(line) and not (len(_WORD.findall(line)) >= 8 and _END.search(line) and _english(line) > 0.25):
            rest += len(_WORD.findall(line))
        elif len(line) < 60 and len(_WORD.findall(line)) < 5 and not _END.search(line):
            rest += len(_WORD.findall(line))
        else:
            line = listed.group(1) if listed else line
            kept.append(_URL.sub(" ", line) if "/" in line or "@" in line or "www." in line or "mailto" in line else line)
    return "\n".join(kept), rest


def _english(text: str) -> float:
    words = re.findall(r"[a-zÀ-ɏ']+", text.lower())
    return sum(w in ENGLISH for w in words) / len(words) if words else 0.0


_VOWELS = re.compile(r"[aeiouy]+")
# Endings and joints at which hyphenation splits otherwise than the vowel groups say.
_LESS = re.compile(r"(?:[^laeiouy]|[aeiou]l|[aeiouy][rnstvcgmpkdbz])e$|[^tdaeiouy]ed$|[^sxzhgcaeiouy]es$|[^aeiouyl]e(?=(?:ly|ment|less|ful|ness)(?:s|ly)?$)|[qg]ue$")
_MORE = re.compile(r"i(?:a(?=[bcgrt])|um|us(?!$)|o(?=[drt])|e(?=nc|nt|ty))|eo(?=[gl])|[aeou]ing$|u(?:al|ou(?=s))|[aeiouym]bl$|ism$|^(?:bi|tri)[aeou]|^re(?=[ei]|act|ass|al)|creat|[^gq]ua(?=[lt])|ying$|[^tscgx]iou")


def syllables(word: str) -> int:
    """Syllables of a lower-case word: vowel groups, less silent endings, more at split joints."""
    if len(word) <= 3:
        return 1
    count = len(_VOWELS.findall(word)) - len(_LESS.findall(word)) + len(_MORE.findall(word))
    return max(1, count)


# identifiers of code: inner capitals, underscores, calls, backquoted names
_NAMES = re.compile(r"`[^`]+`|\b[a-z]+[A-Z]\w*|\b[A-Z][a-z]+[A-Z]\w*|\b\w+_\w+|\b\w+\(\)")


_INNER = re.compile(r"[a-z][A-Z]")


def _on_code(sentence: str) -> bool:
    """Whether a sentence names parts of code; the pattern runs only where it can match."""
    return ("_" in sentence or "`" in sentence or "()" in sentence or _INNER.search(sentence) is not None) and _NAMES.search(sentence) is not None


def _sentences(block: str) -> list[str]:
    """The sentences of a paragraph; where marks are lost, its lines."""
    lines = [x for x in block.split("\n") if x.strip()]
    if not lines:
        return []
    if len(lines) > 1:
        ends = len(_END.findall(block)) * 45
        # a word has at least one character besides the blank before the next
        if ends < len(block) and ends < len(_WORD.findall(block)):
            return lines
    return [x for x in _END.split(" ".join(lines)) if x.strip()]


_known: dict[str, tuple[int, int, int, int]] = {}


def _measures(word: str) -> tuple[int, int, int, int]:
    """(syllables, letters, whether a function word of English, of another language) of a lower-case word."""
    found = _known.get(word)
    if found is None:
        if len(_known) > 200_000:
            _known.clear()
        found = _known[word] = (syllables(word), len(word), word in ENGLISH, word in OTHERS)
    return found


def grades(text: str) -> tuple[int, tuple[float, ...]] | None:
    """(words, grade by each formula), or None if the text is not mainly English prose of enough words."""
    prose, rest = prose_of(text)
    found = [(_on_code(part), own) for block in re.split(r"\n\s*\n", prose) for part in _sentences(block) if (own := _WORD.findall(part))]
    # sentences on names of code do not measure the prose around them, unless there is hardly any other
    clean = [own for named, own in found if not named]
    if sum(map(len, clean)) < LEAST_WORDS:
        clean = [own for _, own in found]
    sentences, words = len(clean), [w for own in clean for w in own]
    n, letters = len(words), 0
    total = hard = chars = long = single = known = foreign = 0
    for word, times in Counter(map(str.lower, words)).items():
        if word[0].isdigit():
            continue
        count, size, here, there = _measures(word)
        letters += times
        total += times * count
        chars += times * size
        if count >= 3:
            hard += times
        elif count == 1:
            single += times
        if size > 6:
            long += times
        known += times * here
        foreign += times * there
    if n < LEAST_WORDS or letters < 0.5 * n or rest > 1.5 * sum(len(own) for _, own in found):
        return None
    if known < 0.12 * letters or foreign > known or foreign > 0.12 * letters:
        return None
    total += n - letters
    chars += n - letters
    length = n / max(1, sentences)
    if length > 45:
        # marks are lost: the length is that of sentences with words as long as these
        length = min(length, max(6.0, 7.5 * total / n - 2.5))
    per, density = total / n, 100 * hard / n
    return n, (
        0.39 * length + 11.8 * per - 15.59,
        0.4 * (length + density),
        1.043 * (30 * hard / n * length) ** 0.5 + 3.1291,
        4.71 * chars / n + 0.5 * length - 21.43,
        5.88 * chars / n - 29.6 / length - 15.8,
        (length + 100 * long / n) / 5,
        20 - 15 * single / n,
    )


class Scale:
    """Puts each formula's grade on the raters' scale and cuts the median into levels."""

    def __init__(self, found: np.ndarray, levels: np.ndarray):
        self.curves = []
        estimates = np.empty_like(found)
        for j in range(found.shape[1]):
            x, y = isotonic(found[:, j], levels)
            self.curves.append((x, y))
            estimates[:, j] = np.interp(found[:, j], x, y)
        self.cuts = best_cuts(np.median(estimates, axis=1), levels)

    def score(self, found: np.ndarray) -> np.ndarray:
        return np.median(np.column_stack([np.interp(found[:, j], x, y) for j, (x, y) in enumerate(self.curves)]), axis=1)

    def level(self, score: np.ndarray) -> np.ndarray:
        return 1 + np.searchsorted(self.cuts, score, side="right")


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit (pool adjacent violators), as the means of its pools."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order].astype(float), strict=True):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b2, n2, a2 = pools.pop()
            b1, n1, a1 = pools[-1]
            pools[-1] = [(b1 * n1 + b2 * n2) / (n1 + n2), n1 + n2, (a1 * n1 + a2 * n2) / (n1 + n2)]
    return np.array([p[2] for p in pools]), np.array([p[0] for p in pools])


def best_cuts(score: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Four thresholds; each the midpoint that tells lower from upper levels with the least error."""
    cuts = []
    order = np.argsort(score, kind="stable")
    s, v = score[order], levels[order]
    for level in range(1, 5):
        below = np.concatenate([[0], np.cumsum(v <= level)])
        wrong = (v <= level).sum() - below + (np.arange(len(v) + 1) - below)
        best = np.flatnonzero(wrong == wrong.min())
        k = int(best[len(best) // 2])
        cuts.append(s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2)
    return np.maximum.accumulate(np.array(cuts))


def _grade_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            found = grades(text)
            if found is not None:
                rows.append((doc, found[0], *found[1]))
        yield pd.DataFrame(rows, columns=["doc_id", "words", *ESTIMATES])


def readable(documents: DataFrame) -> DataFrame:
    """(doc_id, words, one grade per formula) of every document that is mainly English prose."""
    return documents.select("doc_id", "text").where(F.length("text") >= 2 * LEAST_WORDS - 1).mapInPandas(_grade_batches, FEATURES)


def fit_scale(documents: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> Scale:
    """The raters' scale, from at most ``fit_rows`` labelled documents, chosen by a hash of their ids."""
    rated = labels.where("level BETWEEN 1 AND 5").groupBy("doc_id").agg(F.expr("percentile(level, 0.5)").alias("level"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    pdf = readable(documents.join(chosen, "doc_id", "left_semi")).join(chosen, "doc_id").select("level", *ESTIMATES).toPandas()
    if len(pdf) == 0:
        # nothing rated: school grades 4, 7, 10 and 14 as thresholds
        found = np.tile(np.array([2.0, 5.5, 8.5, 12.0, 16.0])[:, None], (1, len(ESTIMATES)))
        return Scale(found, np.arange(1, 6))
    return Scale(pdf[list(ESTIMATES)].to_numpy(), pdf["level"].to_numpy())


def reading_levels(documents: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """(doc_id, level, score, words) of every document of English prose."""
    scale = documents.sparkSession.sparkContext.broadcast(fit_scale(documents, labels, fit_rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _grade_batches(batches):
            if len(batch):
                score = scale.value.score(batch[list(ESTIMATES)].to_numpy())
                yield pd.DataFrame({"doc_id": batch["doc_id"], "level": scale.value.level(score).astype("int32"), "score": score, "words": batch["words"]})

    return documents.select("doc_id", "text").where(F.length("text") >= 2 * LEAST_WORDS - 1).mapInPandas(run, LEVELLED)


def reading_profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents and words per source, type and level."""
    levels = reading_levels(documents, labels)
    places = documents.select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("doc_type", F.lit("none")).alias("doc_type"))
    return levels.join(places, "doc_id").groupBy("source", "doc_type", "level").agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"))
