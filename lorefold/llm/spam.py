"""Pages of repeated keywords, link lists or product tags instead of sentences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.session import cut

# Frequent function words of the supported languages.
FUNCTION_WORDS: dict[str, frozenset[str]] = {
    "en": frozenset(
        "a about after again all also although an and any are as at be because been before both but by can could did do "
        "does for from had has have he her his how i if in into is it its just may me more most my no nobody not of on or "
        "our out over she should since so some someone than that the their them then there these they this those to "
        "until up was we were what when where which while who why will with without would yet you your".split()
    ),
    "de": frozenset(
        "aber alle alles als am an auch auf aus bei bevor bis bisher da damit dass das dem den der des die doch durch ein "
        "eine einem einen einer es für gut haben hat hatte ich ihr im in ist ja kann kein keine man mehr mir mit nach nicht "
        "niemand noch nur ob obwohl oder ohne schon sehr sich sie sind so um und uns vom von vor war was weil weiter wenn "
        "wer wie wir wird wo wurde wurden zu zum zur".split()
    ),
    "fr": frozenset(
        "a ai alors après au aussi autre aux avant avec avons bien c car ce cela ces cette chez comme comment d dans de des "
        "deux du elle elles en encore est et eu fait ici il ils j je l la le les leur lui ma mais me même moi n ne ni nous "
        "on ont ou où par pas personne plus pour pourquoi qu quand que qui s sa sans se selon ses si son sont sous sur "
        "tout très tu un une vos votre vous y à été".split()
    ),
    "es": frozenset(
        "a al algo antes aunque así aún bien como con cuando cómo de del desde dos donde e el ella en entre era es esa ese "
        "esta este esto estaba está fue ha han hasta hay hemos he la las le les lo los mas me mi muy más nadie ni no nos o "
        "para pero por porque qué que quien se según ser si sido sin sobre son su sus sí también tan te tiene todavía todo "
        "todos tras un una uno y ya yo".split()
    ),
}

#: Words a text must have at least to be judged; a link weighs LINK_WORDS of them.
LEAST_WORDS = 12
LINK_WORDS = 4
#: Share of the characters that must be junk.
LEAST_SHARE = 0.5
#: Words to either side in which a word counts as said again.
REACH = 80
#: A sentence has this part of its language's usual share of function words.
SENTENCE_PART = 0.4
#: Share of junk from which a page is spam if SIGNALS of its shares stand out, and how many must for any page.
DOUBTFUL_SHARE = 0.35
SIGNALS_SURE, SIGNALS_DOUBTFUL = 1, 3
#: A share stands out that is this many robust standard deviations above its language's middle; and the least and largest limits of each.
OUTLIER_DEVIATIONS = 4.0
LEAST_LIMITS = {"top_share": 0.1, "ngram_share": 0.08, "repeated_lines": 0.2, "link_share": 0.3, "separators": 0.3}
MOST_LIMITS = {"top_share": 0.25, "ngram_share": 0.3, "repeated_lines": 0.5, "link_share": 0.5, "separators": 1.0}
#: A page lacks function words below this part of its language's usual share.
LACKING_PART = 0.75
#: Dividing strokes a line of tags has at least, and for each of its words.
TAG_STROKES, STROKES_PER_WORD = 8, 0.45
#: Repetition, in robust standard deviations above that of the language's sentences, that makes a segment stuffed.
STUFFED_DEVIATIONS = 4.0

_LINK = re.compile(
    r"<a\b[^<>]{0,400}>[^<>]{0,200}</a>|\[[^\]\n]{0,200}\]\([^)\s]{0,400}\)|(?:https?://|www\.)\S+"
    r"|(?<![\w@.-])\w[\w-]*(?:\.\w[\w-]*)*\.[a-z]{2,12}/\S*|(?<![\w@.-])\w[\w-]*(?:\.\w[\w-]*)*\.(?:com|example|invalid|net|org|test|info|biz|shop|store|online|site|app|dev|io|co|eu|de|at|ch|fr|be|es|it|nl|uk|us)\b(?![\w.@-])",
    re.IGNORECASE,
)
_WORD = re.compile(r"[^\W_]+")
_STROKE = re.compile(r"[/|>»•·#]")
_SEPARATOR = re.compile(r"[,;|·•/>»]| [-–—] |\n")
_SPLIT = re.compile(r"\n+|(?<=[.!?])[\"»”)]?\s+")

#: Counts of a segment, in the order in which they stand in ``segments``.
_COUNTS = ("chars", "links", "link_chars", "words", "function", "content", "again", "tags", "strokes")
_SCHEMA = (
    "doc_id bigint, language string, words int, links int, function_share double, separators double, repeated_lines double, "
    "top_share double, ngram_share double, link_share double, segments array<int>, function_shares array<float>, again_shares array<float>"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("language", pa.string()), ("words", pa.int32()), ("links", pa.int32()), ("function_share", pa.float64()),
    ("separators", pa.float64()), ("repeated_lines", pa.float64()), ("top_share", pa.float64()), ("ngram_share", pa.float64()), ("link_share", pa.float64()), ("segments", pa.list_(pa.int32())),
    ("function_shares", pa.list_(pa.float32())), ("again_shares", pa.list_(pa.float32())),
])
_LINK_SIGN = re.compile(r"/|\w\.[a-z]|\]\(")


def _said_again(words: list[str]) -> list[bool]:
    """For each word, whether two more of the same are within REACH words to either side."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    again = [False] * len(words)
    for own in places.values():
        if len(own) < 3:
            continue
        left = right = 0
        for i in own:
            while own[left] < i - REACH:
                left += 1
            while right < len(own) and own[right] <= i + REACH:
                right += 1
            again[i] = right - left >= 3
    return again


def text_features(text: str) -> tuple:
    """Language, shares and the counts of the segments of one text; the segments are its lines and sentences."""
    pieces: list[tuple[str, int, int]] = []
    links = 0
    for part in _SPLIT.split(text):
        if part and not part.isspace():
            low = part.lower()
            found = _LINK.findall(part) if _LINK_SIGN.search(low) else ()
            links += len(found)
            pieces.append((_LINK.sub(" ", low) if found else low, len(found), sum(map(len, found))))
    per_piece = [_WORD.findall(rest) for rest, _, _ in pieces]
    counts = Counter(w for ws in per_piece for w in ws)
    scores = {name: sum(map(counts.__getitem__, known & counts.keys())) for name, known in FUNCTION_WORDS.items()}
    language = max(scores, key=scores.get)
    known = FUNCTION_WORDS[language].__contains__
    own = [[w for w in ws if not known(w) and not w.isdigit()] for ws in per_piece]
    content_words = [w for ws in own for w in ws]
    again = _said_again(content_words)
    triples = Counter(zip(content_words, content_words[1:], content_words[2:], strict=False))
    ngram_share = sum(n for n in triples.values() if n >= 3) / max(1, len(content_words) - 2)
    top_share = max(map(counts.__getitem__, set(content_words)), default=0) / max(1, len(content_words))
    segments: list[int] = []
    function_shares, again_shares = [], []
    at = words = 0
    for (rest, n, chars), ws, content in zip(pieces, per_piece, own, strict=True):
        function, repeated = sum(map(known, ws)), sum(again[at : at + len(content)])
        at += len(content)
        words += len(ws)
        tags = sum(len(_WORD.findall(x)) for x in rest.split() if x[0] == "#" and len(x) > 2) if "#" in rest else 0
        segments += (len(rest.strip()) + chars, n, chars, len(ws), function, len(content), repeated, tags, len(_STROKE.findall(rest)))
        if len(ws) >= 5:
            function_shares.append(function / len(ws))
            again_shares.append(repeated / max(1, len(content)))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    return (
        language, words, links, scores[language] / max(1, words), len(_SEPARATOR.findall(text)) / max(1, words), 1 - len(set(lines)) / max(1, len(lines)),
        top_share, ngram_share, sum(n for _, _, n in pieces) / max(1, len(text)), segments, function_shares, again_shares,
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            b = batch.slice(at, 512)
            if b.num_rows:
                columns = zip(*(text_features(x or "") for x in b.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[1:], strict=True))], schema=_ARROW)


_SHARES = ("top_share", "ngram_share", "repeated_lines", "link_share", "separators")
_KEPT = ("doc_id", "language", "words", "links", "function_share", *_SHARES)


def _junk_share(segments: list[int], links: int, function_limit: float, again_limit: float, repeats: bool) -> float:
    """The part of the characters in segments that are junk. ``repeats``: whether sentences that say all again may be stuffing here."""
    read, sentences = [], 0
    for i in range(0, len(segments), len(_COUNTS)):
        chars, n, link_chars, words, function, content, again, tags, strokes = segments[i : i + len(_COUNTS)]
        sentence = words >= 4 and function >= function_limit * words and words - function - content <= 0.3 * words
        stuffed = content > 0 and again >= (again_limit if sentence else again_limit / 2) * content and (repeats or not sentence)
        tagged = 2 * tags > words or not sentence and strokes >= max(TAG_STROKES, STROKES_PER_WORD * words) and content >= 0.7 * words
        sentences += sentence and not stuffed
        read.append((chars, link_chars, stuffed or tagged, n > 0 and words < 4 * n and not sentence))
    annotated, junk, whole = sentences >= 0.7 * links, 0, 0
    for chars, link_chars, stuffed, bare in read:
        whole += chars
        if stuffed:
            junk += chars
        elif not annotated:
            junk += chars if bare else link_chars
    return junk / max(1, whole)


def spam_scores(documents: DataFrame) -> DataFrame:
    """(doc_id, language, junk_share, signals, is_spam, ..) of every document.

    A text is cut into lines and sentences. Thresholds are calibrated for each
    language on the corpus itself: the usual share of function words, how much
    the sentences of the language repeat their words nearby, and from which
    value the shares of a page stand out: that of its most frequent word, of
    triples of words said three times, of repeated lines, of text in links, and
    of separators for a word. Together with missing function words these are a
    page's signals.

    A segment is junk if it is made of links or tags, or lacks function words
    and has much said again, or says nearly all again on a page with a word
    that stands out or without function words (so a refrain is no stuffing).
    Links with about as many sentences aren't junk. Lists of different things
    have nothing said again. A text is spam if junk makes up LEAST_SHARE of its
    characters and a signal stands out, or DOUBTFUL_SHARE and most signals do.

    The language is told from the text, ``lang`` isn't read. Null and empty
    texts and those under LEAST_WORDS are no spam; copies of a text get the
    same result; rows with a null id keep it. An empty table gives no rows.
    """
    features = cut(documents.select("doc_id", "text").mapInArrow(_features, _SCHEMA))
    middles = [F.percentile_approx(c, [0.5, 0.9], 1000).alias(f"q_{c}") for c in _SHARES]
    usual = features.filter("words >= 30").groupBy("language").agg(F.percentile_approx("function_share", 0.5, 1000).alias("usual"), *middles)
    usual = cut(usual)  # a row for each language
    sentences = (
        features.filter("words >= 30").join(F.broadcast(usual), "language")
        .select("language", "usual", F.explode(F.arrays_zip("function_shares", "again_shares")).alias("s"))
        .filter(F.col("s.function_shares") >= SENTENCE_PART * F.col("usual")).select("language", F.col("s.again_shares").alias("again"))
    )
    middle = sentences.groupBy("language").agg(F.percentile_approx("again", 0.5, 1000).alias("middle"), F.percentile_approx("again", 0.9, 1000).alias("high"))
    limits, stands_out = {}, {}
    for r in usual.join(middle, "language", "left").collect():  # a row for each language
        again = min(max(r.middle + STUFFED_DEVIATIONS * (r.high - r.middle) / 1.2816, 0.55), 0.75) if r.middle is not None else 0.6
        limits[r.language] = (SENTENCE_PART * r.usual, again)
        stands_out[r.language] = {"lacking": LACKING_PART * r.usual} | {c: min(max(LEAST_LIMITS[c], (q := r[f"q_{c}"])[0] + OUTLIER_DEVIATIONS * (q[1] - q[0]) / 1.2816), MOST_LIMITS[c]) for c in _SHARES}
    unknown = {"lacking": LACKING_PART * 0.4, **LEAST_LIMITS}  # a language without a text of 30 words

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            junk, signals = [], []
            for language, links, function_share, *shares, segments in zip(*(batch.column(n).to_pylist() for n in ("language", "links", "function_share", *_SHARES, "segments")), strict=True):
                own = stands_out.get(language, unknown)
                lacking = function_share < own["lacking"]
                out = [v > own[c] for c, v in zip(_SHARES, shares, strict=True)]
                function_limit, again_limit = limits.get(language, (SENTENCE_PART * 0.4, 0.6))
                junk.append(_junk_share(segments, links, function_limit, again_limit, lacking or out[0]))
                signals.append(lacking + sum(out))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in _KEPT), pa.array(junk, pa.float64()), pa.array(signals, pa.int32())], names=[*_KEPT, "junk_share", "signals"])

    kept = ", ".join(f"{c} double" for c in ("function_share", *_SHARES))
    scored = features.select(*_KEPT, "segments").mapInArrow(judge, f"doc_id bigint, language string, words int, links int, {kept}, junk_share double, signals int")
    enough = F.col("words") + LINK_WORDS * F.col("links") >= LEAST_WORDS
    sure = (F.col("junk_share") >= LEAST_SHARE) & (F.col("signals") >= SIGNALS_SURE)
    return scored.withColumn("is_spam", enough & (sure | (F.col("junk_share") >= DOUBTFUL_SHARE) & (F.col("signals") >= SIGNALS_DOUBTFUL)))


def spam_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents that are spam; see ``spam_scores``."""
    return spam_scores(documents).filter("is_spam AND doc_id IS NOT NULL").select("doc_id")
