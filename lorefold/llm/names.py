"""Linking the spellings people type for one person or project: a noisy-channel attribution."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorefold.llm.groups import connected_groups, roots_of
from lorefold.session import cut

# Short and familiar forms of given names.
NICKNAMES: dict[str, str] = {
    "abby": "abigail", "abbi": "abigail", "ade": "adelaide", "al": "alexander", "alex": "alexander", "sandy": "alexander", "sasha": "alexander",
    "apie": "april", "gus": "augustine", "augie": "augustine", "ben": "benjamin", "benny": "benjamin", "chris": "christopher",
    "topher": "christopher", "kit": "christopher", "corny": "cornelius", "neil": "cornelius", "celi": "celestine", "deb": "deborah",
    "debbie": "deborah", "dot": "dorothea", "dottie": "dorothea", "thea": "dorothea", "desi": "desiree", "ed": "edmund",
    "eddie": "edmund", "ned": "edmund", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth",
    "eliza": "elizabeth", "eva": "evangeline", "evie": "evangeline", "fran": "francesca", "frankie": "francesca", "fanfan": "francoise",
    "fred": "frederick", "freddie": "frederick", "gabi": "gabriela", "gaby": "gabriela", "gracie": "grace", "greg": "gregory",
    "gunni": "gunther", "gunter": "gunther", "hal": "harold", "harry": "harold", "hettie": "henrietta", "etta": "henrietta",
    "hopi": "hope", "lolo": "heloise", "nacho": "ignacio", "bella": "isabella", "izzy": "isabella", "ini": "inigo", "jen": "jennifer",
    "jenny": "jennifer", "jon": "jonathan", "jonty": "jonathan", "joe": "joseph", "joey": "joseph", "joyo": "joy", "jurg": "jurgen", "bjarne": "bjorn",
    "kester": "christopher", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "stoff": "kristoffer", "kris": "kristoffer",
    "leo": "leonard", "len": "leonard", "lenny": "leonard", "renzo": "lorenzo", "lucy": "lucinda", "cindy": "lucinda", "maggie": "margaret",
    "meg": "margaret", "peg": "margaret", "peggy": "margaret", "marky": "mark", "matt": "matthias", "matze": "matthias", "mike": "michael",
    "mikey": "michael", "mick": "michael", "moni": "monica", "nat": "natalia", "talia": "natalia", "nick": "nicholas", "nico": "nicholas",
    "nuri": "nuria", "ollie": "oliver", "olly": "oliver", "tilly": "ottilie", "otti": "ottilie", "pat": "patrick", "paddy": "patrick",
    "pip": "philippa", "pippa": "philippa", "pri": "priyanka", "quent": "quentin", "becky": "rebecca", "becca": "rebecca", "rich": "richard",
    "rick": "richard", "richie": "richard", "dick": "richard", "rob": "robert", "bob": "robert", "bobby": "robert", "bert": "robert", "ros": "rosalind", "roz": "rosalind",
    "sam": "samuel", "sammy": "samuel", "seb": "sebastian", "bastian": "sebastian", "sue": "susannah", "susie": "susannah", "so": "soren",
    "tabby": "tabitha", "theo": "theodore", "ted": "theodore", "teddy": "theodore", "tom": "thomas", "tommy": "thomas", "tess": "therese", "tessa": "therese", "willa": "wilhelmina", "vangie": "evangeline", "gail": "abigail", "tine": "celestine",
    "ulla": "ursula", "val": "valentin", "nessa": "vanessa", "vicky": "victoria", "tori": "victoria", "wandi": "wanda", "mina": "wilhelmina",
    "will": "william", "bill": "william", "billy": "william", "xavi": "xaverine", "yann": "yannick", "yoli": "yolanda", "yola": "yolanda",
    "zach": "zachary", "zack": "zachary", "zsofi": "zsofia", "titi": "etienne", "osqui": "oscar",
}
# Words in a name that aren't part of it.
TITLES = frozenset("dr mr mrs ms prof herr frau sr sra mme mlle of the project client sa gmbh ltd limited inc ag co llc".split())

#: Likelihood of the ways to write a given name or a project's common word.
EXACT, NICKNAME, TYPO, SHORT, INITIAL, TYPO_TWO = 1.0, 0.3, 0.1, 0.1, 0.05, 0.02
#: Likelihood of one certain misspelling of a rare part by 0, 1 and 2 edits (two letters that changed places are one),
#: of a common word left out, and of one too many.
EDITS = (1.0, 0.01, 1e-4)
LEFT_OUT, TOO_MANY = 0.3, 1e-5
#: Rare parts of this many letters may differ by two edits, shorter ones by one.
TWO_EDITS = 6
#: Prior of a form being a name of its own although a more frequent one explains it.
NEW_NAME = 0.005
#: Likelihood of another name standing within one and two edits of a frequent one, against which a form that is seen
#: oftener than misspellings would be is judged.
NEIGHBOUR = (3e-5, 3e-4)
#: Common words of a type are seen with this many different rare parts, and make up this share of all pairs of the
#: type (so there are 1 / COMMON_SHARE of them at most).
PARTNERS = 3
COMMON_SHARE = 1e-5
#: A familiar form shares this part of its rare parts with the full one, and so many times what chance would give.
SHARED, CHANCE = 0.5, 2.0
#: A word is a misspelling by one edit of one so many times as frequent, or in a project's name the short form of one
#: so many times as frequent.
MISSPELT, CUT_SHORT = 10.0, 2.5
#: How much likelier a person is to be meant who stands in the request's list of candidates.
LISTED = 30.0
#: The same for one who doesn't, where there is a list.
UNLISTED = 0.25
#: Part of the rare part's letters that may differ where a mention is compared with the request's own list.
LISTED_EDITS = 0.25
#: Part of an entity's spellings that must speak for a person, and posterior of the persons that aliases join.
CLEAR_SHARE = 0.9

_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|['’\-](?=[^\W\d_]))*\.?")
_CAMEL = re.compile(r"(?<=[^\W\d_A-ZÀ-Þ])(?=[A-ZÀ-Þ])|(?<=\b[A-ZÀ-Þ])(?=[A-ZÀ-Þ][^\W\d_A-ZÀ-Þ])")
_FOLDS = (("ph", "f"), ("ck", "k"), ("c", "k"), ("q", "k"), ("x", "ks"), ("w", "v"), ("y", "i"), ("rn", "m"))


@lru_cache(maxsize=200_000)
def plain(text: str) -> str:
    """Lower case without accents and anything that is no letter."""
    text = text.lower().replace("ø", "o").replace("ł", "l").replace("ß", "ss").replace("æ", "ae").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if c.isalpha())


@lru_cache(maxsize=200_000)
def skeleton(text: str) -> str:
    """``plain`` with letters that sound or look alike folded and doubled letters once."""
    s = plain(text)
    for a, b in _FOLDS:
        s = s.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", s)


def deletions(s: str) -> set[str]:
    """``s`` and what is left of it without one letter."""
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}


def _one_edit(a: str, b: str) -> bool:
    if a == b:
        return True
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def own_words(words: dict[str, int], kind: str) -> list[str]:
    """Words less those that are likely misspellings or short forms of far more frequent ones, given how often each is seen.

    The larger the tables, the more of them are seen with enough rare parts to pass for common words.
    """
    kept: dict[str, int] = {}
    near: dict[str, list[str]] = defaultdict(list)
    heads: dict[str, int] = {}
    bare: dict[str, int] = {}
    for w, n in sorted(words.items(), key=lambda e: (-e[1], e[0])):
        misspelt = len(w) >= 4 and any(kept[k] >= MISSPELT * n and _one_edit(w, k) for d in deletions(w) for k in near.get(d, ()))
        short = kind == "Project" and len(w) >= 3 and max(heads.get(w, 0), bare.get(w, 0)) >= CUT_SHORT * n
        if misspelt or short:
            continue
        kept[w] = n
        for d in deletions(w):
            near[d].append(w)
        for i in range(3, min(len(w), 6)):  # as ``Lexicon.match`` reads them
            heads[w[:i]] = max(heads.get(w[:i], 0), n)
        bare_w = re.sub("[aeiou]", "", w)
        if bare_w != w:
            bare[bare_w] = max(bare.get(bare_w, 0), n)
    return list(kept)


class Lexicon:
    """The common words of a type: given names, or the describing words of projects."""

    def __init__(self, words: list[str], learned: dict[str, str]):
        words = sorted(set(words))
        self.words = {skeleton(w): w for w in words}
        known = {**NICKNAMES, **learned}
        self.nick = {skeleton(k): v for k, v in known.items() if v in words and skeleton(k) not in self.words}
        self.near: dict[str, set[str]] = defaultdict(set)
        for w in words:
            for d in deletions(w):
                self.near[d].add(w)
        self.near_nick: dict[str, set[str]] = defaultdict(set)
        for n in self.nick:
            for d in deletions(n) if len(n) >= 4 else ():
                self.near_nick[d].add(n)
        self.heads: dict[str, set[str]] = defaultdict(set)
        for s, w in self.words.items():
            for n in range(1, len(s)):
                self.heads[s[:n]].add(w)

    def match(self, token: str) -> dict[str, float]:
        """Words that ``token`` may stand for, with their likelihoods."""
        s = skeleton(token)
        if not s:
            return {}
        if s in self.words:
            return {self.words[s]: EXACT}
        found: dict[str, float] = {}
        if s in self.nick:
            found[self.nick[s]] = NICKNAME
        if len(s) == 1:
            alike = {"c", "k"} if plain(token) in ("c", "k") else {plain(token)}
            return found | {w: INITIAL for w in self.words.values() if w[0] in alike}
        dotted = token.endswith(".")
        if dotted or len(s) <= 5:
            for w in self.heads.get(s, ()):
                found[w] = max(found.get(w, 0), SHORT)
        typed = plain(token)
        if not dotted and len(typed) >= 3:
            for d in deletions(typed):
                for w in self.near.get(d, ()):
                    found[w] = max(found.get(w, 0), TYPO if _one_edit(typed, w) else TYPO_TWO if len(typed) >= 6 else 0)
            if len(s) >= 3 and not found:
                for n in sorted({n for d in deletions(s) for n in self.near_nick.get(d, ())}):
                    if n[0] == s[0] and _one_edit(n, s):
                        found[self.nick[n]] = NICKNAME * TYPO
        if not found and not set(typed) & set("aeiou"):  # consonants only: Grp
            found = {w: SHORT for w in self.words.values() if w[0] == typed[0] and typed in re.sub("[aeiou]", "", w)}
        return {w: v for w, v in found.items() if v}

    def split(self, token: str) -> tuple[dict[str, float], str]:
        """A word at the start of a token without spaces, and the rest."""
        s = skeleton(token)
        for n in range(len(s) - 4, 2, -1):
            if s[:n] in self.words:
                return {self.words[s[:n]]: EXACT}, s[n:]
        for n in range(len(s) - 4, 2, -1):
            if s[:n] in self.nick:
                return {self.nick[s[:n]]: NICKNAME}, s[n:]
        for n in range(len(s) - 4, 4, -1):
            near = {w: TYPO for d in deletions(s[:n]) for w in self.near.get(d, ()) if _one_edit(s[:n], w)}
            if near:
                return near, s[n:]
        return {}, s


def parse(text: str, kind: str, lexicon: Lexicon) -> tuple[str, list[dict[str, float]]]:
    """(rare part, common words) of a spelling: surname and given name, or codename and what the project is."""
    text = _CAMEL.sub(" ", text)
    comma = text.find(",")
    tokens = [(m.group(), 0 <= comma < m.start()) for m in _TOKEN.finditer(text.replace("&", " "))]
    if kind == "Project":
        tokens = [(p, late) for t, late in tokens for p in t.split("-") if len(plain(p)) > 1]
    tokens = [(t, late) for t, late in tokens if plain(t) and plain(t) not in TITLES]
    if not tokens:
        return "", []
    if len(tokens) == 1:
        words, rest = lexicon.split(tokens[0][0])
        return rest, [words] if words else []
    if kind == "Person":
        exact = [i for i, (t, _) in enumerate(tokens) if skeleton(t) in lexicon.words]
        if len(exact) == 1 and len(plain(tokens[exact[0]][0])) > 1:  # no other token can match as well
            rare = "".join(plain(t) for i, (t, _) in enumerate(tokens) if i != exact[0] and len(plain(t)) > 1)
            return skeleton(rare), [{lexicon.words[skeleton(tokens[exact[0]][0])]: EXACT}]
    matches = [lexicon.match(t) for t, _ in tokens]
    best = [max(m.values(), default=0.0) for m in matches]
    single = [len(plain(t)) == 1 for t, _ in tokens]
    if kind == "Person":
        order = sorted(range(len(tokens)), key=lambda i: (best[i], tokens[i][1], -i), reverse=True)
        given = next((i for i in order if best[i]), None)
        if given is not None and best[given] < NICKNAME and not single[given]:
            # a weak match must not turn a surname into a given name where a plain initial is at hand
            other = [i for i in order if single[i] and best[i]]
            given = other[0] if other and best[given] < TYPO else given
        rare = "".join(plain(t) for i, (t, _) in enumerate(tokens) if i != given and not single[i])
        return skeleton(rare), [matches[given]] if given is not None else []
    common = [i for i in range(len(tokens)) if best[i]]
    if len(common) == len(tokens):
        weakest = min(common, key=lambda i: (best[i], -len(tokens[i][0])))
        common.remove(weakest)
    rare = "".join(plain(t) for i, (t, _) in enumerate(tokens) if i not in common and not single[i])
    return skeleton(rare), [matches[i] for i in common]


_PARSED = pa.schema([
    ("kind", pa.string()), ("text", pa.string()), ("weight", pa.int64()), ("rare", pa.string()), ("form", pa.string()), ("exact", pa.bool_()),
    ("words", pa.list_(pa.struct([("at", pa.int32()), ("word", pa.string()), ("likely", pa.float64())]))), ("many", pa.int32()),
])


def common_words(forms: DataFrame) -> tuple[dict[str, list[str]], dict[str, dict[str, str]]]:
    """Common words by type, and the familiar or short forms that the data give for them.

    A word is common if it is written with PARTNERS different rare parts: first
    of two words for people, later of three for projects. A word is a familiar
    form of another if most of what it is written with is also written with
    that one, which is far more frequent: where Tilly X is, Ottilie X mostly is.
    Misspellings and short forms of a far more frequent word aren't common words.

    Two words that share SHARED of the rare parts of the first one share at least
    one of its rarest ``n - ceil(SHARED n) + 1``, whichever they are. So they meet
    there, which leaves out the rare parts that go with many words without losing
    a pair of words, and what they share is counted over all rare parts.
    """
    clean = forms.filter(F.col("text").rlike(r"^\p{Lu}\p{Ll}+( \p{Lu}\p{Ll}+){1,2}$")).select("kind", F.split(F.lower("text"), " ").alias("w"))
    people = clean.filter("kind = 'Person' AND size(w) = 2").select("kind", F.lit(0).alias("at"), F.col("w")[0].alias("word"), F.col("w")[1].alias("rest"))
    projects = clean.filter("kind = 'Project' AND size(w) = 3")
    later = [projects.select("kind", F.lit(i).alias("at"), F.col("w")[i].alias("word"), F.concat_ws(" ", F.col("w")[0], F.col("w")[3 - i]).alias("rest")) for i in (1, 2)]
    seen = cut(people.unionAll(later[0]).unionAll(later[1]).distinct())
    often = cut(seen.groupBy("kind", "at", "word").agg(F.count(F.lit(1)).alias("n")))
    total = {r.kind: r.n for r in often.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # two rows
    least = F.greatest(F.lit(PARTNERS), F.when(F.col("kind") == "Person", COMMON_SHARE * total.get("Person", 0)).otherwise(COMMON_SHARE * total.get("Project", 0)))
    words = often.groupBy("kind", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()  # 1 / COMMON_SHARE rows of a type at most
    places = ["kind", "at"]
    rests = seen.groupBy(*places).agg(F.countDistinct("rest").alias("rests"))
    # only words frequent enough to be familiar or full forms
    short = cut(seen.join(often.filter((F.col("n") >= 2) & (F.col("n") >= least * F.lit(2 / PARTNERS))), [*places, "word"]))
    full = cut(short.filter(F.col("n") >= 2.5 * F.greatest(F.lit(2), least * F.lit(2 / PARTNERS))).select(*places, "rest", F.col("word").alias("full"), F.col("n").alias("full_n")))
    spread = seen.groupBy(*places, "rest").agg(F.count(F.lit(1)).alias("words"))
    rarest = Window.partitionBy(*places, "word").orderBy("words", "rest")
    first = short.join(spread, [*places, "rest"]).withColumn("nth", F.row_number().over(rarest)).filter(F.col("nth") <= F.col("n") - F.ceil(F.lit(SHARED) * F.col("n")) + 1)
    far_more = (F.col("full_n") >= 2.5 * F.col("n")) & (F.col("word") != F.col("full"))
    met = first.join(full, [*places, "rest"]).filter(far_more).select(*places, "word", "full").distinct()
    shared = (
        met.join(short, [*places, "word"]).join(full, [*places, "full", "rest"])
        .groupBy(*places, "word", "full").agg(F.count(F.lit(1)).alias("both"), F.first("n").alias("n"), F.first("full_n").alias("full_n")).join(F.broadcast(rests), places)  # three rows
        .filter((F.col("both") >= 2) & (F.col("both") >= SHARED * F.col("n")) & (F.col("both") >= CHANCE * F.col("n") * F.col("full_n") / F.col("rests")))
        .groupBy("kind", "word").agg(F.max(F.struct("both", "full_n", "full")).alias("b")).select("kind", "word", F.col("b.full").alias("full"))
        .collect()  # 3 / (2 * COMMON_SHARE) rows of a type at most
    )
    learned: dict[str, dict[str, str]] = {"Person": {}, "Project": {}}
    for r in shared:
        learned[r.kind][plain(r.word)] = plain(r.full)
    seen_often: dict[str, dict[str, int]] = {"Person": {}, "Project": {}}
    for r in words:
        if plain(r.word) not in learned[r.kind] and not (r.kind == "Person" and plain(r.word) in NICKNAMES):
            seen_often[r.kind][plain(r.word)] = max(r.n, seen_often[r.kind].get(plain(r.word), 0))
    return {kind: own_words(seen_often[kind], kind) for kind in seen_often}, learned


def _less_one(rare: str) -> Column:
    """``deletions`` as a column."""
    return F.concat(F.array(F.col(rare)), F.transform(F.sequence(F.lit(1), F.length(rare)), lambda i: F.concat(F.substring(rare, F.lit(1), i - 1), F.col(rare).substr(i + 1, F.length(rare)))))


def _piece(rare: str, n: Column, p: int, shift: int) -> Column:
    """The letters of ``rare`` where the p-th third of a rare part of n letters stands if it is moved by ``shift``; null if they aren't all there."""
    a, b = (F.floor(n * i / 3).cast("int") for i in (p, p + 1))
    return F.when((n >= TWO_EDITS) & (a + shift >= 0) & (b + shift <= F.length(rare)), F.concat_ws(":", n, F.lit(p), F.substring(rare, a + shift + 1, b - a)))


def keys_of(rare: str) -> Column:
    """Keys of a rare part that is looked up: its thirds, or it and it less one letter if it is short."""
    return F.array_distinct(F.when(F.length(rare) >= TWO_EDITS, F.array(*[_piece(rare, F.length(rare), p, 0) for p in range(3)])).otherwise(_less_one(rare)))


def keys_to(rare: str) -> Column:
    """Keys of a rare part under which every one within the edits allowed finds it by ``keys_of``.

    Two edits leave a third of the other one as it is, moved by ``s`` letters;
    that takes at least ``|s|`` edits before and ``|longer - s|`` after it.
    """
    moves = [(longer, p, s) for longer in range(-2, 3) for p in range(3) for s in range(-2, 3) if abs(s) + abs(longer - s) <= 2]
    thirds = F.array_compact(F.array(*[_piece(rare, F.length(rare) - longer, p, s) for longer, p, s in moves]))
    return F.array_distinct(F.concat(thirds, F.when(F.length(rare) <= TWO_EDITS, _less_one(rare)).otherwise(F.array().cast("array<string>"))))


def link_names(entities: DataFrame, aliases: DataFrame, requests: DataFrame) -> DataFrame:
    """(record_a, record_b), smaller first: entities, and entities and requests, that mean the same person or project.

    Noisy channel. A spelling is read as a rare part (surname, codename) and
    common words (given name; what the project is), which may be misspelt, cut
    short, an initial or a nickname. Exactly read forms are candidate canonical
    forms; their prior is how often they are written, in names, aliases,
    mentions and candidate lists. Every form is attached to the more frequent
    canonical form of greatest posterior, prior times the likelihoods of its
    parts, unless being a name of its own is likelier. An alias is a spelling of
    its entity, so a clear alias joins what it is attached to with its entity.

    Candidates are found by keys of a common word and a piece of the rare part
    (``keys_of``, ``keys_to``), which meet every pair within the edits allowed.
    Nulls, blank or letterless spellings link nothing, nor do rows with a null
    id or types other than Person and Project; repeated rows count once. Empty
    tables give no rows.
    """
    spark = entities.sparkSession
    both = ["Person", "Project"]
    named = entities.select("entity_id", F.col("entity_type").alias("kind"), F.col("name").alias("text")).filter(F.col("entity_id").isNotNull() & F.col("kind").isin(both)).distinct()
    types = named.select("entity_id", "kind").distinct()
    also = aliases.select("entity_id", F.col("alias").alias("text")).distinct().join(types, "entity_id").select("entity_id", "kind", "text")
    asked = requests.select("request_id", F.col("entity_type").alias("kind"), F.col("mention_text").alias("text"), "candidates").filter(F.col("request_id").isNotNull() & F.col("kind").isin(both))
    mentions = asked.select("request_id", "kind", "text").distinct()
    listed = asked.select("kind", "request_id", F.explode("candidates").alias("c")).select("kind", F.col("c.name").alias("text"))
    forms = cut(
        named.select("kind", "text").unionAll(also.select("kind", "text")).unionAll(mentions.select("kind", "text")).unionAll(listed)
        .filter(F.col("text").rlike(r"\p{L}")).groupBy("kind", "text").agg(F.count(F.lit(1)).alias("weight"))
    )
    common = spark.sparkContext.broadcast(common_words(forms))  # at most MOST_COMMON words

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, learned = common.value
        lexicons = {kind: Lexicon(words[kind], learned[kind]) for kind in words}
        for batch in batches:
            out = []
            for kind, text, weight in zip(*(batch.column(n).to_pylist() for n in ("kind", "text", "weight")), strict=True):
                rare, words = parse(text, kind, lexicons[kind])
                flat = [dict(at=i, word=w, likely=v) for i, m in enumerate(words) for w, v in m.items()]
                exact = bool(words) and all(max(m.values()) == EXACT for m in words) and len(words) == (1 if kind == "Person" else 2)
                spec = "+".join(sorted("/".join(f"{w}:{v:g}" for w, v in sorted(m.items())) for m in words))
                if exact:
                    spec = "+".join(sorted(next(iter(m)) for m in words))
                if rare:
                    out.append(dict(kind=kind, text=text, weight=weight, rare=rare, form=f"{kind}|{rare}|{spec}", exact=exact, words=flat, many=len(words)))
            yield pa.RecordBatch.from_pylist(out, schema=_PARSED)

    schema = "kind string, text string, weight long, rare string, form string, exact boolean, words array<struct<at:int,word:string,likely:double>>, many int"
    parsed = cut(forms.select("kind", "text", "weight").mapInArrow(read, schema))
    shapes = cut(parsed.groupBy("form", "kind", "rare", "exact", "many").agg(F.sum("weight").alias("weight"), F.first("words").alias("words")))

    keyed = shapes.select("form", "kind", "rare", "exact", "many", "weight", F.inline("words"))
    right = keyed.filter("exact").select("kind", "word", F.explode(keys_to("rare")).alias("key"), F.col("form").alias("to"), F.col("rare").alias("to_rare"), F.col("weight").alias("to_weight"), F.col("many").alias("to_many"))
    left = keyed.select("kind", "word", F.explode(keys_of("rare")).alias("key"), "form", "rare", "weight", "many", "at", "likely", "exact")
    met = (
        left.join(right, ["kind", "word", "key"]).filter("form <> to")
        .withColumn("edits", F.levenshtein("rare", "to_rare", 2))
        .filter((F.col("edits") >= 0) & (F.col("edits") <= F.when(F.length("rare") >= TWO_EDITS, 2).otherwise(1)))
        .groupBy("form", "to", "at").agg(F.max("likely").alias("likely"), *[F.first(c).alias(c) for c in ("rare", "to_rare", "weight", "to_weight", "many", "to_many", "exact", "edits")])
        .groupBy("form", "to").agg(F.sum(F.log("likely")).alias("log_words"), F.count(F.lit(1)).alias("matched"), F.min("likely").alias("least"), *[F.first(c).alias(c) for c in ("rare", "to_rare", "weight", "to_weight", "many", "to_many", "exact", "edits")])
    )
    letters = lambda c: F.array_sort(F.split(c, ""))
    met = met.withColumn("far", (F.col("edits") == 2) & (letters("rare") != letters("to_rare")))
    edit = F.element_at(F.array(*map(F.lit, EDITS)), F.when(F.col("far"), 3).otherwise(F.least("edits", F.lit(1)) + 1))
    scored = met.withColumn(
        "score",
        F.exp("log_words") * edit * F.col("to_weight") * F.pow(F.lit(LEFT_OUT), F.greatest(F.col("to_many") - F.col("matched"), F.lit(0))) * F.pow(F.lit(TOO_MANY), F.greatest(F.col("many") - F.col("matched"), F.lit(0))),
    ).withColumn("own", F.when(F.col("exact"), NEW_NAME * F.col("weight")).otherwise(NEW_NAME * NEW_NAME))
    # an exactly read form is a misspelling only if it is about as frequent as that one would be
    excess = F.col("weight") - F.col("score") - F.col("weight") * F.log(F.col("weight") / F.col("score"))
    as_typo = F.when(F.col("weight") <= F.col("score"), 1.0).otherwise(F.exp(excess)) > F.when(F.col("far"), NEIGHBOUR[1]).otherwise(NEIGHBOUR[0])
    # and what an entity is called is no misspelling by two edits
    called = cut(named.unionByName(also).join(parsed.select("kind", "text", "form"), ["kind", "text"]).select("form", F.lit(True).alias("is_called")).distinct())
    fitting = cut(
        scored.join(called, "form", "left").filter(~F.col("far") | F.col("is_called").isNull())
        .filter((F.col("exact") & as_typo | ~F.col("exact") & (F.col("score") > F.col("own"))) & (~F.col("exact") | (F.col("to_weight") > F.col("weight")) | ((F.col("to_weight") == F.col("weight")) & (F.col("to") < F.col("form")))))
        .select("form", "to", "score", "own", "least")
    )
    best = fitting.groupBy("form").agg(F.max_by("to", F.struct("score", "to")).alias("to"))
    top = cut(roots_of(best.select(F.col("form").alias("v"), F.col("to").alias("parent"))))
    # who each form may mean: the persons its canonical forms lead to, or the person it is itself
    of_form = parsed.select(F.col("form").alias("v"), "exact").distinct()
    reached = fitting.join(top.select(F.col("v").alias("to"), "parent"), "to", "left").groupBy(F.col("form").alias("v"), F.coalesce("parent", "to").alias("person")).agg(F.sum("score").alias("score"), F.max("own").alias("own"), F.max("least").alias("least"))
    alone = of_form.join(best.select(F.col("form").alias("v")), "v", "left_anti").select("v", F.col("v").alias("person"), F.lit(1.0).alias("score"), F.lit(0.0).alias("own"), F.when(F.col("exact"), EXACT).otherwise(0.0).alias("least"))
    whole = Window.partitionBy("v")
    may_mean = cut(reached.unionByName(alone).withColumn("share", F.col("score") / F.sum("score").over(whole)))
    spelt = parsed.select("kind", "text", F.col("form").alias("v"), "rare", "exact", "words")

    # a request: the persons of its form, those in its list the likelier; and its list by itself, within more edits.
    # Someone nobody knows may be meant as well, unless an entity is spelt just so
    asked_forms = mentions.join(spelt, ["kind", "text"])
    options = asked.select("request_id", "kind", F.explode("candidates.name").alias("text")).distinct().join(spelt.select("kind", "text", "v", "rare", "words"), ["kind", "text"])
    option_persons = options.join(may_mean.filter(F.col("share") >= 0.5), "v").select("request_id", "person", F.col("rare").alias("to_rare"), F.col("words").alias("to_words")).dropDuplicates(["request_id", "person"])
    has_list = asked.filter(F.size("candidates") > 0).select("request_id", F.lit(UNLISTED).alias("fall")).distinct()
    known_forms = called.select(F.col("form").alias("v"), F.col("is_called").alias("is_known"))
    lift = F.coalesce("lift", "fall", F.lit(1.0))
    by_form = (
        asked_forms.select("request_id", "v").join(may_mean, "v").join(known_forms, "v", "left").join(has_list, "request_id", "left")
        .join(option_persons.select("request_id", "person", F.lit(LISTED).alias("lift")), ["request_id", "person"], "left")
        .filter(F.coalesce(F.col("is_known"), F.lit(False)) | (F.col("score") * lift > F.col("own")))
        .select("request_id", "person", (F.col("share") * lift).alias("weight"))
    )
    most = F.greatest(F.lit(1), F.floor(F.length("to_rare") * LISTED_EDITS))
    edits = F.levenshtein("rare", "to_rare")
    alike = (F.size("words") == 0) | F.arrays_overlap("words.word", "to_words.word")
    by_list = asked_forms.select("request_id", "rare", "words").join(option_persons, "request_id").filter(alike & (edits <= most)).select("request_id", "person", (F.lit(LISTED) * F.pow(F.lit(0.3), edits)).alias("weight"))
    meant = cut(by_form.unionByName(by_list).groupBy("request_id", "person").agg(F.max("weight").alias("weight")).groupBy("request_id").agg(F.max_by("person", F.struct("weight", "person")).alias("person")))

    # an entity: the person its spellings speak for together
    spellings = named.unionByName(also).distinct().join(spelt.select("kind", "text", "v"), ["kind", "text"]).join(may_mean, "v")
    clear = F.when(F.col("least") > INITIAL, F.col("share"))
    votes = cut(spellings.groupBy("entity_id", "person").agg(F.sum("share").alias("votes"), F.max(clear).alias("best")))
    chosen = votes.groupBy("entity_id").agg(F.max_by("person", F.struct("votes", "person")).alias("person"))
    links = chosen.select(F.concat(F.lit("e:"), "entity_id").alias("x"), F.concat(F.lit("p:"), "person").alias("y"))
    # an alias that clearly is someone's spelling joins that one with the entity
    also_links = votes.filter(F.col("best") >= CLEAR_SHARE).select(F.concat(F.lit("e:"), "entity_id").alias("x"), F.concat(F.lit("p:"), "person").alias("y"))
    grouped = cut(connected_groups(links.unionByName(also_links), "x", "y"))
    members = grouped.filter("record_id LIKE 'e:%'").select(F.substring("record_id", 3, 1 << 20).alias("id"), "group_id")
    persons = grouped.filter("record_id LIKE 'p:%'").select(F.substring("record_id", 3, 1 << 20).alias("person"), "group_id")
    wanted = meant.join(persons, "person").select(F.col("request_id").alias("other"), "group_id").distinct()
    others = members.select(F.col("id").alias("other"), "group_id")
    pairs = members.join(others, "group_id").filter("id < other").select("id", "other").unionAll(members.join(wanted, "group_id").select("id", "other"))
    return pairs.filter("id <> other").select(F.least("id", "other").alias("record_a"), F.greatest("id", "other").alias("record_b")).distinct()
