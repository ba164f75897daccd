"""Personal information in free text: finding it by bootstrapped contexts, and typed placeholders."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.llm.names import NICKNAMES, Lexicon, common_words, deletions, parse, plain, skeleton
from lorefold.llm.surface import ADDRESS, CODE_WIDTH, ID, KINDS, OTHER, PHONE, candidates, digest, digit_runs, kept_digest, surface_spans
from lorefold.session import cut

#: Rounds of scoring patterns by their instances and instances by their patterns.
ROUNDS = 3
#: Different words a pattern needs, and the confidence from which a word counts as a name.
PATTERN_WORDS = 4
NAME_CONFIDENCE = 0.55
#: Confidence of its context from which a word that is also a common word is a name.
CONTEXT_CONFIDENCE = 0.5
#: Words below this length that are learned as names are decided by their context each time, as are such seeds.
SURE_LETTERS = 6
#: Occurrences a pattern, and a shape, of numbers or streets needs, and the confidences of shape and of shape and context from which an instance is taken.
CODE_SUPPORT = 4
SHAPE_CONFIDENCE, CODE_CONFIDENCE = 0.3, 0.55
#: Words that contexts are made of have this share of all words (so there are 1 / CONTEXT_SHARE at most); others are of the kind <rare>.
CONTEXT_SHARE = 1e-5
#: Labels, the most frequent first, that every task holds; all others are joined with the texts.
HOT_LABELS = 100_000
#: Rows up to which the labels asked for beside these are broadcast rather than shuffled with the texts.
SMALL_ROWS = 50_000
#: Bits of the filter that keeps words without a label out of that join.
FILTER_BITS = 1 << 26

# Titles, and given names that are words or months of the languages too.
TITLES = frozenset("dr mr mrs ms prof herr frau sr sra mme mlle".split())
AMBIGUOUS = frozenset(
    "april august bill dick dot etta gail grace gus hal harry hope jack joy kit mark marky may mina nat ned neil pat peg pip "
    "pri rich rob rose sandy so sue theo tine titi tom val will wills ini al ed len leo sam ben ros seb deb".split()
)
_PARTICLES = ("van", "von", "de", "der", "del", "da")
_NO_WORDS = ("so", "al", "an")
#: Kinds of words that make a name.
_NAMING = frozenset("GAgSs")
#: Private characters that stand for a found span, and for the edge of a text, in the row of words.
_MASKS, _EDGE = "\ue001\ue002\ue003\ue004\ue005", "\ue000"


def _letters() -> str:
    """All letters of the basic plane as ranges of a character class, which is searched much faster than a negated one."""
    runs: list[list[int]] = []
    for cp in range(0x10000):
        if chr(cp).isalpha():
            if runs and runs[-1][1] == cp - 1:
                runs[-1][1] = cp
            else:
                runs.append([cp, cp])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


_LETTERS = _letters()
_WORD = re.compile(rf"[{_LETTERS}{_MASKS}]+(?:['’\-][{_LETTERS}]+)*")
#: Salts that tell the labels of one hash apart: near given names, weak names, numbers and streets by kind.
NEAR, WEAK, CODES = 0x5BD1E995, 0x1B873593, (0, 0x2545F491, 0x3C6EF372, 0x27D4EB2F)


@lru_cache(maxsize=200_000)
def _forms(word: str) -> tuple[str, ...]:
    """A word without a genitive, and the longer parts of a compound."""
    if word.isalpha():
        return (word,)
    base = word[:-2] if word.endswith(("'s", "’s")) else word
    return (base, *sorted({p for p in re.split("[-'’]", base) if len(p) > 3 and p != base}))


def near_given(p: str, lexicon: Lexicon) -> float:
    """Likelihood of a plain word of five letters or more being a misspelt given name."""
    if len(p) < 5 or p in lexicon.heads:
        return 0.0
    return max(lexicon.match(p).values(), default=0.0)


def base_kind(word: str, p: str, given: frozenset[str]) -> str:
    """T title, i single letter, G given name, A one that is a common word too, - other; ``p`` is the word in plain letters."""
    if word in _NO_WORDS:
        return "-"
    if p in TITLES:
        return "T"
    if len(p) == 1:
        return "i"
    if p in given:
        return "A" if p in AMBIGUOUS else "G"
    if p is not word:
        if "-" in word and all(plain(x) in given for x in word.split("-")):
            return "G"
        if word.endswith(("'s", "’s")) and plain(word[:-2]) in given:
            return "A" if plain(word[:-2]) in AMBIGUOUS else "G"
    return "-"


def _mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes in order."""
    h = (a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


class Labels:
    """What a task knows of labels: the frequent ones, and a filter that every other one passes."""

    def __init__(self, hot: dict[int, float], bits: np.ndarray):
        self.hot, self.bits = hot, bits

    def may_have(self, key: int) -> bool:
        """Whether there may be a label for ``key`` beside the frequent ones."""
        bits, a, b = self.bits, key & FILTER_BITS - 1, key >> 26 & FILTER_BITS - 1
        return bool(bits[a >> 3] >> (a & 7) & 1 and bits[b >> 3] >> (b & 7) & 1)


class Reader(dict):
    """The words that a task has met, numbered, with what is known of each; and rows of words as arrays.

    ``common``: words that are no names, whose occurrences count under one form.
    """

    def __init__(self, given: frozenset[str], frequent: frozenset[str], labels: Labels | None = None, common: frozenset[str] = frozenset()):
        super().__init__()
        self.given, self.frequent, self.labels, self.common = given, frequent, labels, common
        self.kinds: list[str] = []
        self.forms: list[tuple[int, ...]] = []
        self.classes: list[int] = []
        self.asked: list[tuple[int, ...]] = []
        self.known: list[dict[int, float]] = []
        self.kinds_known: list[str] = []
        self.fixed = {c: digest(c) for c in ("<title>", "<initial>", "<given>", "<rare>")}

    def __missing__(self, token: str) -> int:
        if token[0] in _MASKS or token[0] == _EDGE:
            kind, own, hashed = "-", (), kept_digest(token[0])
        else:
            word = token.lower()
            p = word if word.isascii() and word.isalpha() else plain(word)
            kind = base_kind(word, p, self.given)
            own = ()
            if len(p) > 1 and (p not in self.given or p in AMBIGUOUS):
                own = (0,) if word in self.common else tuple([kept_digest(f) for f in _forms(word)])
            if p in TITLES:
                hashed = self.fixed["<title>"]
            elif len(p) == 1:
                hashed = self.fixed["<initial>"]
            elif p in self.given and p not in AMBIGUOUS:
                hashed = self.fixed["<given>"]
            else:
                hashed = kept_digest(word) if word in self.frequent else self.fixed["<rare>"]
        self.kinds.append(kind)
        self.forms.append(own)
        self.classes.append(hashed)
        if self.labels:
            keys = [k for f in own for k in (f, f ^ NEAR, f ^ WEAK)] if kind in "-T" and token.lower() not in _NO_WORDS else ()
            hot, may_have = self.labels.hot, self.labels.may_have
            self.known.append({k: hot[k] for k in keys if k in hot})
            self.asked.append(tuple([k for k in keys if may_have(k)]))
        self[token] = len(self)
        return len(self) - 1

    def labelled(self) -> list[str]:
        """What every word is by the labels that all tasks hold."""
        for code in range(len(self.kinds_known), len(self)):
            self.kinds_known.append(_labelled_kind(self.kinds[code], self.forms[code], self.known[code], {}))
        return self.kinds_known

    def rows(self, texts: list[str], flats: list[list[int]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Numbers of the words of all texts, two edges after each; where each text begins; its three patterns at every word; and which of these say nothing."""
        if len(self) > 500_000:
            self.clear()
            self.kinds, self.forms, self.classes, self.asked, self.known, self.kinds_known = [], [], [], [], [], []
        flat: list[str] = [_EDGE, _EDGE]
        starts = []
        for text, spans in zip(texts, flats, strict=True):
            starts.append(len(flat))
            flat += _WORD.findall(masked(text, spans) if spans else text)
            flat += (_EDGE, _EDGE)
        codes = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        classes = np.array(self.classes, np.int64)[codes]
        rare = classes == self.fixed["<rare>"]
        classes = classes.view(np.uint64)
        n = len(flat)
        patterns = [np.zeros(n, np.int64) for _ in range(3)]
        dull = [np.ones(n, bool) for _ in range(3)]
        mid = slice(2, n - 2)
        l2, l1, r1, r2 = (slice(2 + d, n - 2 + d) for d in (-2, -1, 1, 2))
        for i, (a, b) in enumerate(((l1, r1), (l2, l1), (r1, r2))):
            if n > 4:
                patterns[i][mid] = _mixed(classes[a], classes[b], i + 1)
                dull[i][mid] = rare[a] & rare[b]
        return codes, np.array([*starts, n], np.int64), patterns, dull


def masked(text: str, flat: list[int]) -> str:
    """The text with a private character and blanks in place of each found span; it keeps its length."""
    parts, at = [], 0
    for i in range(0, len(flat), 3):
        parts += (text[at : flat[i]], _MASKS[flat[i + 2]].ljust(flat[i + 1] - flat[i]))
        at = flat[i + 1]
    return "".join([*parts, text[at:]])


def decode_names(text: str, words: list[re.Match], kinds: list[str], trust: dict[int, float]) -> list[tuple[int, int]]:
    """Spans of person names among ``words`` of the ``kinds`` T, i, G, A, g (perhaps a misspelt given name), S surname, s (perhaps one).

    ``trust``: confidence of the context, by place, of words that are decided by it.
    """
    n, text_end = len(words), len(text)
    lower = lambda i: words[i].group().lower()
    places = [i for i, k in enumerate(kinds) if k != "-"]
    for i in places:
        if kinds[i] == "i":
            a, b = words[i].span()
            if (b < text_end and text[b] == "." or text[a].isupper()) and text[a] not in "iI":
                kinds[i] = "I"

    def gap(i: int) -> str:
        return text[words[i].end() : words[i + 1].start()] if i + 1 < n else "\n"

    def joined(i: int) -> bool:
        g = gap(i)
        return g in (" ", "-") or g.strip() == "." and kinds[i] in "IiT" or g.isspace() and "\n" not in g

    for i in places:  # perhaps a surname: it is one after a given name, or where its context says so
        if kinds[i] == "s":
            kinds[i] = "S" if i and kinds[i - 1] in "GI" and joined(i - 1) or trust.get(i, 0.0) >= CONTEXT_CONFIDENCE else "-"
    found, past = [], 0
    for i in places:
        k = kinds[i]
        if i < past:
            continue
        if k in "GAgIi":
            j = i
            while j + 1 < n and kinds[j + 1] in "Ii" and joined(j):
                j += 1
            if j + 2 < n and kinds[j + 2] == "S" and joined(j) and lower(j + 1) in _PARTICLES and joined(j + 1):
                j += 1
            if j + 1 < n and kinds[j + 1] == "S" and joined(j):
                found.append((words[i].start(), words[j + 1].end()))
                past = j + 2
                continue
            if k in "GA" and i + 1 < n and kinds[i + 1] in "GA" and gap(i) == "-":
                found.append((words[i].start(), words[i + 1].end()))
                past = i + 2
                continue
            if k == "G" or k in "Ag" and (trust.get(i, 0.0) >= CONTEXT_CONFIDENCE or i and kinds[i - 1] == "T"):
                found.append(words[i].span())
        elif k == "S":
            j = i
            follows = kinds[i + 1] if i + 1 < n else "-"
            if follows in "GAgI" and (joined(i) or gap(i).strip() == "," and "\n" not in gap(i)):
                two = i + 2 < n and kinds[i + 2] == "S" and joined(i + 1) and gap(i).strip() != ","
                if not two and not (follows == "A" and joined(i) and i + 2 < n and trust.get(i + 1, 0.0) < 0.2 and lower(i + 2) in ("the", "that")):
                    j = i + 1
                    while j + 1 < n and kinds[j + 1] == "I" and joined(j):
                        j += 1
            elif follows in "Si" and joined(i) and (follows == "S" or lower(i + 1) not in ("a", "i", "y", "e", "o")):
                j = i + 1
            found.append((words[i].start(), words[j].end()))
            past = j + 1
    return found


def _texts(captures: DataFrame) -> DataFrame:
    both = [captures.select("capture_id", F.lit(c).alias("text_field"), F.col(c).alias("text")) for c in ("raw_text", "corrected_text")]
    return both[0].unionAll(both[1]).filter("capture_id IS NOT NULL AND text IS NOT NULL").distinct()


def _lists(column: pa.ListArray) -> list[list[int]]:
    """The lists of a column of numbers, a null as an empty one; ``to_pylist`` takes each number by itself."""
    values, ends = column.values.to_numpy().tolist(), column.offsets.to_numpy().tolist()
    return [values[a:b] if a < b else [] for a, b in zip(ends, ends[1:])]  # noqa: B905 (each end with the next)


_SURFACE = "capture_id string, text_field string, text string, flat array<int>, codes array<long>"


def _with_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the surface spans of a text as start, end and number of the kind, one after the other, and its open candidates."""
    for batch in batches:
        flats, codes = [], []
        flat_ends, code_ends = [0], [0]
        for text in batch.column("text").to_pylist():
            runs = digit_runs(text)
            spans = surface_spans(text, runs)
            for span in spans:
                flats += span
            flat_ends.append(len(flats))
            if runs:
                codes += candidates(text, spans, runs)
            code_ends.append(len(codes))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(held, t)) for ends, held, t in ((flat_ends, flats, pa.int32()), (code_ends, codes, pa.int64()))]
        columns = [*(batch.column(n) for n in ("capture_id", "text_field", "text")), *lists]
        yield pa.RecordBatch.from_arrays(columns, names=["capture_id", "text_field", "text", "flat", "codes"])


def _code_labels(texts: DataFrame) -> DataFrame:
    """(k, v, n): confidences of shapes and of their contexts by kind, learned from what the grammars and labels decide.

    A pattern's confidence in a kind is the part of its occurrences that are of
    that kind, a shape's the mean confidence of its occurrences; each takes up
    the other's in turn, so a shape that mostly stands in trusted contexts is
    found in others too.
    """
    part = lambda at: F.element_at("codes", F.col("at") * CODE_WIDTH + at)
    each = texts.filter("size(codes) > 0").select("codes", F.explode(F.sequence(F.lit(0), (F.size("codes") / CODE_WIDTH).cast("int") - 1)).alias("at"))
    seen = each.select(part(3).alias("form"), F.explode(F.array(part(4), part(5), part(6))).alias("pattern"), part(CODE_WIDTH).alias("kind"))
    edges = cut(seen.groupBy("form", "pattern").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).alias(f"s{k}") for k in (PHONE, ID, ADDRESS)]))
    kinds = (PHONE, ID, ADDRESS)
    forms = edges.groupBy("form").agg(*[(F.sum(f"s{k}") / F.sum("n")).alias(f"v{k}") for k in kinds])
    values = [f"v{k}" for k in kinds]

    def scored(own: str, other: str, by: DataFrame) -> DataFrame:
        part_of = [(F.sum(F.greatest(F.col(f"s{k}"), F.col("n") * F.coalesce(f"v{k}", F.lit(0.0)))) / F.sum("n")).alias(f"v{k}") for k in kinds]
        return cut(edges.join(by.select(other, *values), other, "left").groupBy(own).agg(F.sum("n").alias("times"), *part_of).filter(F.greatest(*values) > 0.1))

    for _ in range(2):
        patterns = scored("pattern", "form", forms).filter(F.col("times") >= CODE_SUPPORT)
        forms = scored("form", "pattern", patterns).filter(F.col("times") >= 3 * CODE_SUPPORT)  # three patterns an occurrence
    out = forms.select(F.col("form").alias("k"), "times", *values).unionAll(patterns.select("pattern", "times", *values))
    salted = F.array(*[F.struct(F.col("k").bitwiseXOR(F.lit(CODES[k])).alias("k"), F.col(f"v{k}").alias("v"), F.col("times").alias("n")) for k in kinds])
    return out.select(F.inline(salted)).filter("v > 0.1")


def decide_codes(codes: list[int], own: dict[int, float], hot: dict[int, float]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of open candidates whose shape and best context are trusted enough for a kind."""
    out = []
    for i in range(CODE_WIDTH - 1, len(codes), CODE_WIDTH):
        if codes[i] >= 0:
            continue
        a, b, form, *contexts = codes[i - CODE_WIDTH + 1 : i]
        best = (0.0, -1)
        for kind in (PHONE, ID, ADDRESS):
            salt = CODES[kind]
            shape = own.get(form ^ salt, hot.get(form ^ salt, 0.0))
            if shape >= SHAPE_CONFIDENCE:
                around = max([own.get(c ^ salt, hot.get(c ^ salt, 0.0)) for c in contexts])
                if (shape + around) / 2 >= CODE_CONFIDENCE:
                    best = max(best, (shape + around, kind))
        if best[1] >= 0:
            out.append((a, b, best[1]))
    return out


def _bloom(labels: DataFrame) -> np.ndarray:
    """The filter of labels as bytes; its size is fixed by FILTER_BITS."""
    places = labels.select(F.explode(F.array(F.col("k").bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftright("k", 26).bitwiseAND(F.lit(FILTER_BITS - 1)))).alias("bit"))
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    # at most FILTER_BITS / 64 rows
    held = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("b")).toArrow()
    words[held.column("word").to_numpy()] = held.column("b").to_numpy().view(np.uint64)
    return words.view(np.uint8)


def _tallied(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """How often each pair of form and pattern occurs."""
    form, pattern = (np.concatenate([k[i] for k in pairs]) if pairs else np.zeros(0, np.int64) for i in range(2))
    pair = _mixed(form.view(np.uint64), pattern.view(np.uint64), 7)
    order = np.argsort(pair)  # np.unique with places sorts stably, which takes many times as long
    pair = pair[order]
    begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1]]))
    first, counts = order[begins], np.diff(begins, append=len(pair))
    return pa.RecordBatch.from_arrays([pa.array(form[first]), pa.array(pattern[first]), pa.array(counts.astype(np.int64))], names=["form", "pattern", "n"])


def find_personal(captures: DataFrame, people: DataFrame, projects: DataFrame, *, whole: bool = True) -> DataFrame:
    """(capture_id, text_field, text, spans): every text with array<struct<kind, start_pos, end_pos>>.

    Not ``whole``: (capture_id, text_field, pii_kind, start_pos), the same as
    ``occurrences`` of it, without the texts and spans going through the JVM.

    Bootstrapping, over the whole corpus. Seeds of emails, phone and identity
    numbers and addresses are what their grammars and labels decide, written
    and spoken; shapes of numbers and words of streets that no grammar takes
    are found by the contexts they share with seeds. Seeds of names (``people``)
    mark words, the contexts of marked words become patterns, patterns are
    scored by the part of their instances that are marked and words by the
    confidence of their patterns, in ROUNDS rounds; words of enough confidence
    are names from then on, as are spellings one letter from a seed.
    ``projects`` gives words that are no names. Words that are both, such as
    Mark, and short ones are decided by their context.

    ``people`` and ``projects`` have a column ``text``. Null texts and ids give
    nothing, empty texts no spans; repeated rows are one. Texts are read whole.
    """
    spark = captures.sparkSession
    texts = cut(_texts(captures).mapInArrow(_with_spans, _SURFACE))
    forms = cut(people.select(F.lit("Person").alias("kind"), "text").filter(F.col("text").rlike(r"\p{L}")).distinct())
    words, learned = common_words(forms)
    lexicon_words = spark.sparkContext.broadcast((words["Person"], learned["Person"]))  # bounded by the vocabulary of given names
    given = frozenset(words["Person"]) | frozenset(learned["Person"]) | frozenset(NICKNAMES)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts[text != text.lower()].update(_WORD.findall(text))
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield _counted(counts)
        yield _counted(counts)

    def _counted(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        """Times a form is met, and how much oftener it has a capital than not in texts that have capitals."""
        by_form: dict[str, list[int]] = {}
        for cased, counter in enumerate(counts):
            for word, n in counter.items():
                if word[0] not in _MASKS:
                    for form in _forms(word.lower()):
                        held = by_form.setdefault(form, [0, 0])
                        held[0] += n
                        held[1] += (n if word[0].isupper() else -n) * cased
            counter.clear()
        columns = (list(by_form), [digest(f) for f in by_form], [v[0] for v in by_form.values()], [v[1] for v in by_form.values()])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["form", "h", "n", "capitals"])

    counted = cut(texts.mapInArrow(count_words, "form string, h long, n long, capitals long").groupBy("form").agg(F.min("h").alias("h"), F.sum("n").alias("n"), (F.sum("capitals") < 0).alias("small")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = counted.filter(F.col("n") >= CONTEXT_SHARE * total).select("form", "small").toArrow()  # at most 1 / CONTEXT_SHARE
    frequent = spark.sparkContext.broadcast(frozenset(often.column("form").to_pylist()))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*lexicon_words.value)
        held: set[str] = set()
        for batch in batches:
            new = {s for t in batch.column("text").to_pylist() for s, w in [parse(t, "Person", lexicon)] if w and len(s) > 1} - held
            held |= new
            if len(held) > 200_000:
                held = set()
            yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], names=["surname"])

    def seed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names_ = batch.column("surname").to_pylist()
            keys = [(h, digest(k), long) for s in names_ for h, long in [(digest(s), len(s) > 4)] for k in (deletions(s) if long else (s,))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in keys], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["surname", "key", "long"])

    surnames = cut(forms.select("text").mapInArrow(seeds, "surname string").distinct())
    surname_keys = cut(surnames.mapInArrow(seed_keys, "surname long, key long, long boolean"))

    def nearness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How near every form is to a given name, and the hash of its skeleton."""
        lexicon = Lexicon(*lexicon_words.value)
        for batch in batches:
            texts_ = batch.column("form").to_pylist()
            near = [0.0 if (p := plain(f)) in given else near_given(p, lexicon) for f in texts_]
            columns = [batch.column("form"), batch.column("h"), batch.column("n"), batch.column("small"), pa.array([len(f) for f in texts_], pa.int32()), pa.array(near, pa.float64()), pa.array([digest(skeleton(f)) for f in texts_], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["text", "form", "n", "small", "letters", "near", "own"])

    def form_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys under which a form meets the surnames that it may misspell."""
        for batch in batches:
            rows = [(h, digest(k)) for f, h in zip(batch.column("text").to_pylist(), batch.column("form").to_pylist(), strict=True) if len(s := skeleton(f)) > 4 for k in deletions(s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(2)], names=["form", "key"])

    known = counted.mapInArrow(nearness, "text string, form long, n long, small boolean, letters int, near double, own long").join(
        surname_keys.filter("surname = key").select(F.col("surname").alias("own"), "long").distinct(), "own", "left"
    )
    known = cut(known)
    # words in small letters are no misspellings of a name
    near_seeds = known.filter("long IS NULL AND NOT small").select("text", "form").mapInArrow(form_keys, "form long, key long").join(surname_keys.filter("long").select("key").distinct(), "key").select("form", F.lit(0.9).alias("close")).distinct()
    no_names = projects.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).filter(F.length("word") > 2).distinct()
    never = known.join(no_names, F.col("text") == F.col("word"), "left_semi").select("form", F.lit(True).alias("project"))
    seed = F.when(F.col("project"), 0.0).when(F.col("long").isNotNull(), 1.0).otherwise(F.coalesce("close", F.lit(0.0)))
    is_long = F.coalesce(F.col("long"), F.col("close").isNotNull())
    marks = cut(
        known.join(near_seeds, "form", "left").join(never, "form", "left").withColumn("seed", seed)
        .select("form", "n", "near", F.col("seed").alias("score"), ((F.col("letters") < SURE_LETTERS) & ~((F.col("seed") > 0) & is_long)).alias("weak"), (F.coalesce("project", F.lit(False)) | F.col("small") & (F.col("seed") == 0)).alias("never"))
    )
    # words in small letters that are no seeds are no names: of these the frequent ones share one form below
    listed = spark.createDataFrame([(f, digest(f)) for f, small in zip(*(often.column(c).to_pylist() for c in ("form", "small")), strict=True) if small], "word string, form long")
    common = spark.sparkContext.broadcast(frozenset(r.word for r in listed.join(marks.filter("never"), "form").select("word").collect()))  # at most 1 / CONTEXT_SHARE

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        reader = Reader(given, frequent.value, common=common.value)
        for batch in batches:
            codes, _, patterns, dull = reader.rows(batch.column("text").to_pylist(), _lists(batch.column("flat")))
            many = np.array([len(f) for f in reader.forms], np.int64)
            first = np.array([f[0] if f else 0 for f in reader.forms], np.int64)
            for pattern, says_nothing in zip(patterns, dull, strict=True):
                at = np.flatnonzero((many[codes] > 0) & ~says_nothing)
                held.append((first[codes[at]], pattern[at]))
                rows = [(f, p) for c, p in zip(codes[at[many[codes[at]] > 1]].tolist(), pattern[at[many[codes[at]] > 1]].tolist(), strict=True) for f in reader.forms[c][1:]]
                if rows:
                    held.append((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)))
            if sum(len(h[0]) for h in held) > 3_000_000:
                yield _tallied(held)
                held = []
        yield _tallied(held)

    # only words that are neither seeds nor ruled out change in the rounds; what seeds give a pattern is summed up once
    standing = F.when(F.col("never"), "n").when(F.col("score") >= NAME_CONFIDENCE, "s").otherwise("o")
    # the pairs of a form are brought together once, for the counts and for the join; those of the form that common words share are spread by pattern
    place = F.when(F.col("form") == 0, F.col("pattern")).otherwise(F.col("form"))
    met = (
        texts.select("text", "flat").mapInArrow(contexts, "form long, pattern long, n long").withColumn("place", place).repartition("place")
        .groupBy("place", "form", "pattern").agg(F.sum("n").alias("n"))
        .join(marks.select(F.col("form").alias("place"), standing.alias("standing")).hint("shuffle_hash"), "place", "left")
        .select("form", "pattern", "n", F.when(F.col("form") != 0, F.col("standing")).alias("standing"))
        .persist(StorageLevel.MEMORY_AND_DISK)  # read twice right below; what is lost with an executor is worked out again
    )
    patterns = cut(
        met.groupBy("pattern").agg(F.count_if(F.col("form") != 0).alias("forms"), F.sum("n").alias("n"), F.sum(F.when(F.col("standing") == "s", F.col("n")).otherwise(0)).alias("seeded"))
        .filter(F.col("forms") >= PATTERN_WORDS).select("pattern", "n", "seeded")
    )
    open_forms = met.filter("standing = 'o'").select("form", "pattern", "n")
    totals = open_forms.groupBy("form").agg(F.sum("n").alias("all"))
    edges = cut(open_forms.join(patterns.select("pattern").hint("shuffle_hash"), "pattern").join(totals.hint("shuffle_hash"), "form"))
    met.unpersist()
    trust = patterns.select("pattern", "n", (F.col("seeded") / F.col("n")).alias("trust"))
    learned_names = None
    for last in [False] * (ROUNDS - 1) + [True]:
        by_context = edges.join(trust.filter("trust > 0").select("pattern", "trust"), "pattern").groupBy("form").agg((F.sum(F.col("trust") * F.col("n")) / F.first("all")).alias("score"))
        learned_names = cut(by_context.filter(F.col("score") >= NAME_CONFIDENCE))
        gained = edges.join(learned_names.select("form"), "form").groupBy("pattern").agg(F.sum("n").alias("gained"))
        trust = patterns.join(gained, "pattern", "left").select("pattern", "n", ((F.col("seeded") + F.coalesce("gained", F.lit(0))) / F.col("n")).alias("trust"))
        trust = trust if last else cut(trust.filter("trust > 0"))
    marks = marks.join(learned_names.withColumnRenamed("score", "learned"), "form", "left").withColumn("score", F.greatest("score", F.coalesce("learned", F.lit(0.0))))
    names = marks.filter(F.col("score") >= NAME_CONFIDENCE).select(F.when(F.col("weak"), F.col("form").bitwiseXOR(F.lit(WEAK))).otherwise(F.col("form")).alias("k"), F.col("score").alias("v"), "n")
    near = marks.filter("near > 0").select(F.col("form").bitwiseXOR(F.lit(NEAR)).alias("k"), F.col("near").alias("v"), "n")
    trusted = trust.filter(F.col("trust") >= 0.2).select(F.col("pattern").alias("k"), F.col("trust").alias("v"), "n")
    labels_of = cut(names.unionAll(near).unionAll(trusted).unionAll(_code_labels(texts)))
    top = labels_of.orderBy(F.desc("n"), "k").limit(HOT_LABELS).toArrow()  # the others are joined below
    hot = dict(zip(top.column("k").to_pylist(), top.column("v").to_pylist(), strict=True))
    least = top.column("n")[len(hot) - 1].as_py() if len(hot) == HOT_LABELS else 0
    other_labels = labels_of.filter(F.col("n") <= least)
    held_labels = spark.sparkContext.broadcast((hot, _bloom(other_labels)))  # HOT_LABELS entries and FILTER_BITS bits

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The labels that a text may need beside the frequent ones."""
        labels = Labels(*held_labels.value)
        reader = Reader(given, frequent.value, labels)
        for batch in batches:
            names_, fields, codes_ = batch.column("capture_id").to_pylist(), batch.column("text_field").to_pylist(), _lists(batch.column("codes"))
            tokens, starts, patterns_, _ = reader.rows(batch.column("text").to_pylist(), _lists(batch.column("flat")))
            own: dict[int, set[int]] = {}
            for at, row in _decided(reader, tokens, starts):
                keys = [*reader.asked[tokens[at]], *(k for p in patterns_ if labels.may_have(k := int(p[at])))]
                if keys:
                    own.setdefault(row, set()).update(keys)
            for row, codes in enumerate(codes_):
                for i in range(0, len(codes), CODE_WIDTH):
                    if codes[i + CODE_WIDTH - 1] < 0:
                        keys = [k for c in codes[i + 2 : i + CODE_WIDTH - 1] for salt in CODES[1:] if labels.may_have(k := c ^ salt)]
                        if keys:
                            own.setdefault(row, set()).update(keys)
            out = [(names_[row], fields[row], k) for row, keys in own.items() for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["capture_id", "text_field", "k"])

    asked = "capture_id string, text_field string, k long"
    if other_labels.isEmpty():  # every task holds all labels
        cold = spark.createDataFrame([], asked)
    else:
        cold = texts.mapInArrow(wanted, asked)
    cold = cut(cold.join(other_labels.select("k", "v"), "k").groupBy("capture_id", "text_field").agg(F.collect_list(F.struct("k", "v")).alias("labels")))
    if cold.count() <= SMALL_ROWS:
        cold = F.broadcast(cold)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = Labels(*held_labels.value)
        hot = labels.hot
        reader = Reader(given, frequent.value, labels)
        for batch in batches:
            texts_, flats, codes_ = batch.column("text").to_pylist(), _lists(batch.column("flat")), _lists(batch.column("codes"))
            owns = _own_labels(batch.column("labels"))
            tokens, starts, patterns_, _ = reader.rows(texts_, flats)
            kinds_ = reader.labelled()
            open_ = np.array([k in _NAMING or bool(owns and a) for k, a in zip(kinds_, reader.asked, strict=True)], bool)
            places = np.flatnonzero(open_[tokens])
            ends, around = np.searchsorted(places, starts).tolist(), list(zip(*[p[places].tolist() for p in patterns_], strict=True))
            places, tokens, starts = places.tolist(), tokens.tolist(), starts.tolist()
            rows_out, kinds_out, starts_out, stops_out = [], [], [], []
            for row, (text, flat, codes) in enumerate(zip(texts_, flats, codes_, strict=True)):
                named = range(ends[row], ends[row + 1])
                if not (flat or codes or named):
                    continue
                own = owns.get(row, {})
                fresh = decide_codes(codes, own, hot) if codes else []
                if named:
                    first = starts[row]
                    mine = tokens[first : starts[row + 1] - 2]
                    kinds = [kinds_[t] for t in mine]
                    trust = {}
                    for j in named:
                        at = places[j] - first
                        if own:
                            kinds[at] = _labelled_kind(reader.kinds[mine[at]], reader.forms[mine[at]], reader.known[mine[at]], own)
                        if kinds[at] in "Ags":
                            trust[at] = max([own.get(k, hot.get(k, 0.0)) for k in around[j]])
                    if not _NAMING.isdisjoint(kinds):
                        streets = [f for f in fresh if f[2] == ADDRESS]  # a learned street gives way to a name
                        fresh = [f for f in fresh if f[2] != ADDRESS] + [(a, b, len(KINDS)) for a, b in decode_names(text, list(_WORD.finditer(masked(text, flat) if flat else text)), kinds, trust)] + streets
                everything = [(flat[i], flat[i + 1], flat[i + 2]) for i in range(0, len(flat), 3)]
                if fresh:
                    everything += [(a, b, k) for i, (a, b, k) in enumerate(fresh) if not any([a < y and x < b for x, y, _ in everything + fresh[:i]])]
                for a, b, k in sorted(everything):
                    if k != OTHER:
                        rows_out.append(row)
                        kinds_out.append(k)
                        starts_out.append(a)
                        stops_out.append(b)
            names_ = pa.array([*KINDS, "person_name"]).take(pa.array(kinds_out, pa.int32()))
            starts_, stops_ = pa.array(starts_out, pa.int64()), pa.array(stops_out, pa.int64())
            if whole:
                ends = pa.array(np.searchsorted(np.array(rows_out, np.int64), np.arange(len(texts_) + 1)), pa.int32())
                spans = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([names_, starts_, stops_], names=["kind", "start_pos", "end_pos"]))
                yield pa.RecordBatch.from_arrays([batch.column("capture_id"), batch.column("text_field"), batch.column("text"), spans], names=["capture_id", "text_field", "text", "spans"])
            else:
                at_ = pa.array(rows_out, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("capture_id").take(at_), batch.column("text_field").take(at_), names_, starts_], names=["capture_id", "text_field", "pii_kind", "start_pos"])

    schema = "capture_id string, text_field string, text string, spans array<struct<kind:string,start_pos:bigint,end_pos:bigint>>" if whole else "capture_id string, text_field string, pii_kind string, start_pos bigint"
    return texts.join(cold, ["capture_id", "text_field"], "left").select("capture_id", "text_field", "text", "flat", "codes", "labels").mapInArrow(decode, schema)


def _own_labels(column: pa.ListArray) -> dict[int, dict[int, float]]:
    """The labels of a text that were joined, by row."""
    values, ends = column.values, column.offsets.to_numpy()
    keys, trust = (values.field(i).to_numpy(zero_copy_only=False).tolist() for i in range(2))
    return {row: dict(zip(keys[ends[row] : ends[row + 1]], trust[ends[row] : ends[row + 1]], strict=True)) for row in np.flatnonzero(np.diff(ends)).tolist()}


def _decided(reader: Reader, tokens: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place, text) of the words that are, or may be, part of a name."""
    flagged = np.array([k in "GA" or bool(a) or bool(h) for k, a, h in zip(reader.kinds, reader.asked, reader.known, strict=True)], bool)
    places = np.flatnonzero(flagged[tokens])
    yield from zip(places.tolist(), (np.searchsorted(starts, places, side="right") - 1).tolist(), strict=True)


def _labelled_kind(kind: str, forms: tuple[int, ...], known: dict[int, float], own: dict[int, float]) -> str:
    """What a word is by its labels: a surname, perhaps one, or a given name that is misspelt."""
    if kind in "GAiT":
        return kind
    labels = {**known, **own} if own else known
    near, weak = 0.0, False
    for f in forms:
        if labels.get(f, 0.0) >= NAME_CONFIDENCE:
            return "S"
        near = max(near, labels.get(f ^ NEAR, 0.0))
        weak = weak or labels.get(f ^ WEAK, 0.0) >= NAME_CONFIDENCE
    return "G" if near >= 0.3 else "s" if weak else "g" if near >= 0.03 else kind


def occurrences(found: DataFrame) -> DataFrame:
    """(capture_id, text_field, pii_kind, start_pos): one row per occurrence."""
    return found.select("capture_id", "text_field", F.explode("spans").alias("s")).select("capture_id", "text_field", F.col("s.kind").alias("pii_kind"), "s.start_pos")


def redact(found: DataFrame) -> DataFrame:
    """(capture_id, text_field, redacted): the texts with placeholders such as [EMAIL] in place of what was found."""
    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                parts, at = [], 0
                for s in spans:
                    parts += [text[at : s["start_pos"]], f"[{s['kind'].upper()}]"]
                    at = s["end_pos"]
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("capture_id"), batch.column("text_field"), pa.array(out, pa.string())], names=["capture_id", "text_field", "redacted"])

    return found.mapInArrow(swap, "capture_id string, text_field string, redacted string")
