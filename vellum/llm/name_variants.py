"""Variant spellings of people's names within a unit, linked by joining tries.

Names are folded (accents, look-alikes, Cyrillic letters to Latin ones), freed of titles, and read as a given name and a
surname. What is most likely given follows from how often the whole corpus has a token in first place; where that leaves the
order open, the permuted order is a reading of the name too. A person is known by first initial and surname, so all rows with
the same two are one node. The nodes of a unit and initial are a shard; its surnames form a trie, along which a Levenshtein
automaton walks for every surname to list its neighbours within a bounded distance. A node is linked to every neighbour
whose given names agree, a permuted reading only where both given names are written out and agree; the links' components are
the people. A shard that outgrows ``SHARD`` nodes is walked in blocks, every surname against every block.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.canonical_titles import one_script
from vellum.llm.lookalikes import CYRILLIC_LIKE
from vellum.operators.components import connected_components
from vellum.session import cut_lineage

#: A token counts as a given name if it stands first in at least one name of so many; so at most as many come to the driver.
#: Rarer given names need no such count: a name whose order it leaves open has its permuted order as a reading as well.
GIVEN_SHARE = 5_000
#: Surnames of one trie; a larger shard is split into blocks.
SHARD = 20_000

# Short forms of given names.
NICKNAMES = {
    "aga": "agnieszka", "alex": "alexander", "basti": "sebastian", "becky": "rebecca", "ben": "benjamin", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "bob": "robert", "bobby": "robert", "charlie": "charlotte",
    "chris": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dolly": "dorothy", "dot": "dorothy", "ed": "edward", "eddie": "edward", "ellie": "eleanor", "fred": "frederick",
    "freddie": "frederick", "gaby": "gabrielle", "greg": "gregory", "hannes": "johannes", "jim": "james", "jo": "josephine", "joe": "joseph", "jon": "jonathan", "josie": "josephine", "kate": "katherine", "kathy": "katherine", "katie": "katherine",
    "kit": "christopher", "len": "leonard", "leo": "leonard", "lenny": "leonard", "liz": "elizabeth", "lottie": "charlotte", "lupe": "guadalupe", "maggie": "margaret", "matt": "matthew", "max": "maximilian", "meg": "margaret", "mike": "michael",
    "minna": "wilhelmine", "nacho": "ignacio", "ned": "edward", "nell": "eleanor", "nick": "nicholas", "olek": "aleksander", "paco": "francisco", "pat": "patricia", "peggy": "margaret", "penny": "penelope", "ray": "raymond", "rike": "friederike",
    "rob": "robert", "ronnie": "veronica", "sam": "samuel", "sandy": "alexander", "steve": "stephen", "sue": "susannah", "susie": "susannah", "ted": "theodore", "theo": "theodore", "tim": "timothy", "tom": "thomas", "tomek": "tomasz",
    "tony": "anthony", "trish": "patricia", "vicky": "victoria", "will": "william", "xavi": "xaver", "zbyszek": "zbigniew",
}
#: Short forms that stand for a second name as well.
SECOND_NAMES = {"ted": "edward", "alex": "aleksander", "sam": "samira", "chris": "christina", "nell": "penelope", "pat": "patrick", "fred": "friederike", "sandy": "aleksander", "max": "maxine", "jo": "johannes", "gaby": "gabriel"}
_TITLES = frozenset("prof professor dr drs mr mrs ms miss mx sir dame assoc associate asst assistant adj emeritus emer univ phd dphil msc bsc ba ma mphil mba md llm llb jr sr ii iii habil dipl ing hc doc mag rer nat frau herr mme mlle don dona проф доц др акад she her he him they them ze".split())
_PARTICLES = frozenset("van der den de del della di da do dos das du la le les von vom zu zur ter ten te af av el al bin ibn und".split())
_GLUED = re.compile(r"^(?:vander|vonder|vanden|vande|van|von|del|de|da|ter)(?=[a-z]{5})")
_CYRILLIC = {v: k for k, v in CYRILLIC_LIKE.items() if v.isalpha() and v.isascii()}
# Cyrillic letters in Latin ones.
_ROMAN = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ", "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya e i i e g".split(), strict=True))
_ROMAN = {k: v.replace("-", "") for k, v in _ROMAN.items()}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’`][^\W\d_]+)*|[,;]", re.U)
_DROP = re.compile(r"[­͏؜​-‏‪-‮⁠-⁤﻿]")
_BRACKETS = re.compile(r"[(（\[][^)）\]]*[)）\]]")
_DEGREES = re.compile(r"(?<!\w)(?:Ph\.?\s?D|D\.?\s?Phil|[MB]\.?\s?Sc|M\.?\s?Phil|Dr\.?\s?habil|M\.?\s?Eng|LL\.?\s?[MB]|Ed\.?\s?D)(?!\w)\.?|,\s*[MB]\.?\s?A\.?\s*(?=,|$)|(?<!\w)[Dд]-р(?!\w)|(?<!\w)a/prof(?!\w)", re.I)
#: Without any of these a name has neither brackets nor degrees.
_ADDED = re.compile(r"[.,;/()（）\[\]’-]|[PDBMLEpdbmle]\s?(?:[Hh]|[Ss]|[Ll]|[Ee]|[Dd]|[Rr]\s)")
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ı": "i", "ß": "ss", "æ": "a", "œ": "o", "þ": "th", "ð": "d"})


@lru_cache(50_000)
def _roman(word: str) -> str:
    """One word in plain Latin letters, its look-alikes exchanged for those of the word's own script."""
    low = word.casefold()
    if low.isascii():
        return low
    cyrillic = any("Ѐ" <= c <= "ԯ" for c in word)
    low = word.casefold()
    low = "".join(_ROMAN.get(c, c) for c in unicodedata.normalize("NFC", low)) if cyrillic else low
    low = unicodedata.normalize("NFD", low.translate(_LETTERS))
    return "".join(c for c in low if not unicodedata.combining(c))


@lru_cache(50_000)
def _key(word: str) -> str:
    """Digraphs for umlauts and doubled letters become one letter, so that ``oe``, ``ö`` and ``o`` agree."""
    return re.sub(r"(.)\1", r"\1", re.sub(r"(?<=[aou])e", "", word))


def name_tokens(name: str) -> tuple[list[tuple[str, bool, bool]], int]:
    """Tokens of a name without titles: (plain form, single letter, all capitals), and where its comma stands, or -1."""
    text = name if name.isascii() else unicodedata.normalize("NFKC", _DROP.sub("", name))
    if _ADDED.search(text):
        text = _DEGREES.sub(" ", _BRACKETS.sub(" ", text).replace("’", "'"))
    if not text.isascii():
        text = one_script(text)
        if any(c in _ROMAN and c not in CYRILLIC_LIKE for c in text.lower()):  # a lone Latin initial of a Cyrillic name
            text = re.sub(r"(?<!\w)[A-Z](?![\w'])", lambda m: _CYRILLIC.get(m.group(), m.group()), text)
    out: list[tuple[str, bool, bool]] = []
    comma = -1
    for t in _TOKEN.findall(text):
        if t in ",;":
            if out and comma < 0:
                comma = len(out)
            continue
        plain = _roman(t).replace("'", "")
        if not plain or plain in _TITLES or t.casefold() in _TITLES:
            continue
        out.append((plain, len(t) == 1, len(t) > 2 and t.isupper()))
    if comma >= len(out):
        comma = -1
    return out, comma


class GivenNames:
    """A set of given names that also knows what is one typing error away from them, by symmetric deletes."""

    def __init__(self, names: frozenset[str]) -> None:
        self.names = names
        self.by_delete: dict[str, list[str]] = {}
        self.seen: dict[str, str] = {}
        for g in sorted(x for x in names | frozenset(NICKNAMES) if len(x) > 3):
            for d in {g, *(g[:i] + g[i + 1 :] for i in range(len(g)))}:
                self.by_delete.setdefault(d, []).append(g)

    def __contains__(self, token: str) -> bool:
        return token in self.names

    def near(self, token: str) -> str:
        """The first given name within one edit or swap of a token of four letters or more, one of the same initial before others; '' if there is none."""
        if len(token) < 4:
            return ""
        found = self.seen.get(token)
        if found is None:
            cuts = {token, *(token[:i] + token[i + 1 :] for i in range(len(token)))}
            found = self.seen[token] = min((g for d in cuts for g in self.by_delete.get(d, ()) if one_edit(token, g)), key=lambda g: (g[0] != token[0], g), default="")
        return found


def one_edit(a: str, b: str) -> bool:
    """One letter changed, left out, added, or two neighbours swapped, at most."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return len(b) == len(a) + 1 and a[k:] == b[k + 1 :]


def parsed(name: str, given_names: GivenNames) -> list[tuple[str, str, str, bool]]:
    """(first initial, given name or '', surname, permuted) of a name; the first is what it most likely is, others are possible too."""
    tokens, comma = name_tokens(name)
    tokens_in = [(t, one, caps) for t, one, caps in tokens]
    low = [t for t, _, _ in tokens_in]
    # lower-case "v. d." between names stands for particles
    particle = [t in _PARTICLES for t in low]
    for i in range(len(low) - 1):
        if low[i] == "v" and i and (low[i + 1] == "d" or (i + 2 == len(low) and len(low[i + 1]) > 3 and " v" in name)):
            particle[i] = True
            if low[i + 1] == "d":
                particle[i + 1] = True
    if comma < 0 and len(low) > 2 and tokens_in[0][1] and low[0] in "vdt" and len(low[1]) > 3 and low[1] not in given_names and any(one or t in given_names for t, one, _ in tokens_in[2:]):
        particle[0] = True  # "V. SURNAME H": an initial follows, or a given name, so the first letter is a particle
    if 0 < comma < len(low):
        left = [i for i in range(comma) if not particle[i]]
        right = [i for i in range(comma, len(low)) if not particle[i]]
        if left and right and not all(tokens_in[i][1] for i in left):
            surname, given = left, right
        else:
            surname, given = [], left + right
    else:
        surname, given = [], [i for i in range(len(low)) if not particle[i]]

    def kind(i: int) -> str:
        t, one, _ = tokens_in[i]
        if one:
            return "I"
        if t in given_names or t in NICKNAMES:
            return "G"
        return "g" if given_names.near(t) else "S"

    open_order: list[int] = []
    if not surname:
        every = given
        if not every:
            return []
        if len(every) == 1:
            return [("", "", _key(low[every[0]]), False)]
        capitals = [i for i in every if tokens_in[i][2]]
        after_particle = next((i for i in every if i and particle[i - 1]), None)
        kinds = {i: kind(i) for i in every}
        if capitals and len(capitals) < len([i for i in every if len(low[i]) > 2]):
            surname = capitals
        elif any(k == "S" for k in kinds.values()) and any(k != "S" for k in kinds.values()):
            surname = [i for i in every if kinds[i] == "S"]
        elif any(k == "g" for k in kinds.values()) and any(k in "GI" for k in kinds.values()):
            surname = [i for i in every if kinds[i] == "g"]
        elif after_particle is not None:
            surname = [i for i in every if i >= after_particle]
        else:
            surname = [i for i in every if not tokens_in[i][1]][-1:] or every[-1:]
            if len(every) > 1 and not any(tokens_in[i][1] for i in every):
                open_order = every
        given = [i for i in every if i not in surname]
        if not given:
            given, surname = surname[:1], surname[1:]
        if not surname:
            return []
    if len(surname) > 1 and any(kind(i) == "G" for i in surname) and any(kind(i) == "S" for i in surname):
        surname = [i for i in surname if kind(i) != "G"]
    family = "".join(_key(low[i]) for i in surname)
    first = low[given[0]]
    full = "" if tokens_in[given[0]][1] else first if first in given_names or first in NICKNAMES else given_names.near(first) or first
    formal = NICKNAMES.get(full, full)
    out = [((formal or first)[:1], formal, family, False)]
    second = SECOND_NAMES.get(full)
    if second:
        out.append((second[:1], second, family, False))
    if len(surname) > 1:
        out += [(out[0][0], formal, _key(low[i]), False) for i in surname if len(low[i]) > 3]
    if m := _GLUED.match(family):
        out.append((out[0][0], formal, family[m.end() :], False))
    for i in open_order:  # token orders that the counts leave open
        if i not in surname:
            other = next(j for j in reversed(open_order) if j != i)
            out.append((low[other][:1], low[other], _key(low[i]), True))
    return out


def allowed_edits(surname: str) -> int:
    """Surnames of three and four letters may be one edit apart where the given names are written out and equal."""
    return 0 if len(surname) < 3 else 1 if len(surname) < 8 else 2


class Trie:
    """Surnames of a shard, walked by a Levenshtein automaton that also counts swapped neighbours as one edit.

    The automaton's states (letters of the word consumed, edits so far) are bits of one number for each count of edits.
    Surnames of one length hang from one root, since lengths that differ by more than the edits can't be near.
    """

    def __init__(self, words: Iterable[str] = ()) -> None:
        self.roots: dict[int, dict] = {}
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        at = self.roots.setdefault(len(word), {})
        for c in word:
            at = at.setdefault(c, {})
        at[""] = word

    def near(self, word: str, most: int) -> list[tuple[str, int]]:
        """(other word, distance) for every word of the trie within ``most`` edits."""
        out: list[tuple[str, int]] = []
        places: dict[str, int] = {}
        for i, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << i
        end = 1 << len(word)
        start = tuple((2 << e) - 1 for e in range(most + 1))  # letters of the word left out at the beginning
        stack = [(self.roots[n], start, None, 0) for n in range(len(word) - most, len(word) + most + 1) if n in self.roots]
        while stack:
            node, states, before, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    if states[most] & end and child != word:
                        out.append((child, next(e for e, bits in enumerate(states) if bits & end)))
                    continue
                here = places.get(c, 0)
                bits = (states[0] & here) << 1
                new = [bits]
                for e in range(1, most + 1):
                    fewer = states[e - 1]
                    bits = (states[e] & here) << 1 | fewer | fewer << 1 | bits << 1
                    if before is not None:
                        bits |= (before[e - 1] & last >> 1 & here) << 2
                    new.append(bits)
                if bits & (end << 1) - 1:
                    stack.append((child, new, states, here))
        return out


def given_agree(a: list[str], b: list[str], surname_edits: int) -> bool:
    """Given names of two nodes of the same initial: one known and equal up to a typing error, or one side unknown."""
    if not a or not b:
        return surname_edits <= 2
    for x in a:
        for y in b:
            if x == y or x.startswith(y) or y.startswith(x):
                return True
            if min(len(x), len(y)) >= 4 and Trie([y]).near(x, 2 if min(len(x), len(y)) > 6 else 1):
                return True
    return False


_LINKS = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


def linked(a: tuple[str, bool, list[str]], b: tuple[str, bool, list[str]], edits: int) -> bool:
    """Whether two nodes (surname, permuted, given names) of one initial, so many edits apart, are the same person."""
    shorter = min(len(a[0]), len(b[0]))
    if edits > allowed_edits(a[0]) or edits > allowed_edits(b[0]):
        return False
    if edits and shorter < 5:
        return any(len(x) > 1 and x in b[2] for x in a[2])
    if a[1] or b[1]:
        return bool(a[2]) and bool(b[2]) and given_agree(a[2], b[2], edits)
    return given_agree(a[2], b[2], edits)


def shard_links(rows: list[tuple]) -> list[tuple[str, str]]:
    """Links of one shard's block: rows are (node, surname, permuted, a given name or '', own block); all walk, the block's own stand in the trie."""
    if len(rows) < 2:
        return []
    nodes: dict[str, tuple] = {}
    for node, surname, permuted, given, own in rows:
        if node not in nodes:
            nodes[node] = (node, surname, permuted, [], own)
        if given:
            nodes[node][3].append(given)
    by_name: dict[str, list[tuple]] = {}
    for r in nodes.values():
        by_name.setdefault(r[1], []).append(r)
    own = {s for s, rs in by_name.items() if any(r[4] for r in rs)}
    trie, out = Trie(), []
    for surname in sorted(by_name, key=lambda x: x not in own):  # the block's own find those before them, the others find all
        mine = by_name[surname]
        near = trie.near(surname, allowed_edits(surname))
        if surname in own:
            trie.add(surname)
            if len(mine) > 1:
                near.append((surname, 0))
        for other, edits in near:
            for r in mine:
                for q in by_name[other]:
                    if r[0] != q[0] and linked(r[1:4], q[1:4], edits):
                        out.append((r[0], q[0]))
    return out


def _shard_links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within each shard; the rows of a partition come sorted by shard and block, one block is held at a time."""
    shard, held, found = None, [], []
    for frame in frames:
        for place, node, surname, permuted, given, own in zip(*(frame[c] for c in frame.columns), strict=True):
            if place != shard:
                found += shard_links(held)
                shard, held = place, []
            held.append((node, surname, permuted, given, own))
        if len(found) > 5_000:
            yield pd.DataFrame(found, columns=["a", "b"])
            found = []
    found += shard_links(held)
    yield pd.DataFrame(found, columns=["a", "b"])


_FORMS = T.ArrayType(T.StructType([T.StructField("i", T.StringType()), T.StructField("g", T.StringType()), T.StructField("s", T.StringType()), T.StructField("p", T.BooleanType())]))


def _common_given_names(rows: DataFrame) -> frozenset[str]:
    """Tokens that stand first (or after the comma) in one name of ``GIVEN_SHARE``, mostly there, in several units.

    Counted in the JVM over rough tokens; only the tokens that pass, at most ``GIVEN_SHARE``, come to the driver and are folded.
    """
    skip = sorted(_TITLES | _PARTICLES)
    plain = F.lower(F.when(F.col("name").rlike(r"[(（\[]"), F.regexp_replace("name", r"[(（\[][^)）\]]*[)）\]]", " ")).otherwise(F.col("name")))
    words = lambda c: F.filter(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{M}]{2,})"), 1), lambda x: ~x.isin(skip))
    before, after = words(F.substring_index("_p", ",", 1)), F.when(F.instr("_p", ",") > 0, words(F.regexp_extract("_p", r",(.*)$", 1)))
    each = rows.select("unit_id", plain.alias("_p")).select("unit_id", before.alias("_b"), after.alias("_a"))
    comma = (F.size("_a") > 0) & (F.size("_b") > 0)
    given = F.when(comma, F.get("_a", F.lit(0))).when(F.size("_b") > 1, F.get("_b", F.lit(0)))
    family = F.when(comma, F.get("_b", F.lit(0))).when(F.size("_b") > 1, F.get("_b", F.size("_b") - 1))
    side = lambda c, k: F.struct(c.alias("t"), F.lit(k).alias("k"))
    tokens = each.select("unit_id", F.explode(F.array(side(given, 0), side(family, 1))).alias("x")).select("unit_id", "x.t", "x.k").where("t is not null")
    first = F.sum(F.when(F.col("k") == 0, 1).otherwise(0))
    in_units = [f(F.when(F.col("k") == 0, F.col("unit_id"))) for f in (F.min, F.max)]
    sums = cut_lineage(tokens.groupBy("t").agg(first.alias("f"), F.sum("k").alias("l"), in_units[0].alias("u0"), in_units[1].alias("u1")))
    total, u0, u1 = sums.agg(F.sum("f"), F.min("u0"), F.max("u1")).first()
    common = sums.where((F.col("f") >= max(2, (total or 0) // GIVEN_SHARE)) & (F.col("f") > 2 * F.col("l")))
    if u0 != u1:
        common = common.where("u0 < u1")
    return frozenset(_roman(unicodedata.normalize("NFKC", r[0])) for r in common.select("t").collect())


def people(rows: DataFrame, unit_col: str = "unit_id", id_col: str = "record_id", name_col: str = "name") -> DataFrame:
    """``unit_id, record_id, person`` for every row with a name; ``person`` is the same for all rows of one person of a unit.

    Null and blank names have no row, nor do rows without a unit. A name of one token stands for itself. Equal names of a
    unit are always the same person; a row repeated comes out once.
    """
    base = rows.select(F.col(unit_col).alias("unit_id"), F.col(id_col).alias("record_id"), F.col(name_col).alias("name")).where(F.col("name").rlike(r"(?U)\w")).where("unit_id is not null and record_id is not null")
    given = _common_given_names(base)

    @F.pandas_udf(_FORMS)
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = GivenNames(given)
        for batch in batches:
            done = {x: parsed(x, names) for x in batch.unique()}
            yield batch.map(done)

    # non-deterministic by declaration, so that the optimiser evaluates it once, where it stands
    parsed_rows = base.select("unit_id", "record_id", forms.asNondeterministic()("name").alias("_f"))
    key = lambda f: F.concat_ws("|", F.col("unit_id").cast("string"), f["i"], f["s"], F.when(f["p"], f["g"]))
    placed = cut_lineage(parsed_rows.where(F.size("_f") > 0).select("unit_id", "record_id", key(F.get("_f", F.lit(0))).alias("node"), "_f"))
    # other readings of a name may be nodes without rows of their own, tied to the first reading
    reading = lambda f: F.struct(key(f).alias("node"), f["i"].alias("i"), f["s"].alias("s"), f["g"].alias("g"), f["p"].alias("p"))
    readings = placed.select("unit_id", F.explode(F.transform("_f", reading)).alias("x")).where("x.i != '' and length(x.s) > 2")
    shard = F.concat_ws("|", F.col("unit_id").cast("string"), "x.i").alias("shard")
    sharded = cut_lineage(readings.select(shard, "x.node", "x.s", "x.p", "x.g").distinct())
    large = sharded.groupBy("shard").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("_blocks")).where("_blocks > 1")  # at most one row for each SHARD nodes
    sharded = sharded.join(F.broadcast(large), "shard", "left").withColumn("_own", F.pmod(F.xxhash64("s"), F.coalesce("_blocks", F.lit(1))).cast("int"))
    sharded = sharded.withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)))
    sharded = sharded.select(F.concat_ws("|", "shard", F.col("_block").cast("string")).alias("place"), "node", "s", "p", "g", (F.col("_own") == F.col("_block")).alias("own"))
    found = sharded.repartition("place").sortWithinPartitions("place").mapInPandas(_shard_links, _LINKS)
    others = placed.where(F.size("_f") > 1).select("unit_id", F.col("node").alias("a"), F.explode(F.slice("_f", 2, F.size("_f"))).alias("_x")).select("a", key(F.col("_x")).alias("b")).distinct()
    grouped = connected_components(found.unionByName(others))
    linked_rows = placed.select("unit_id", "record_id", "node").join(grouped, "node", "left").select("unit_id", "record_id", F.coalesce("component", "node").alias("person"))
    return linked_rows.repartition("unit_id", "person").distinct()  # the order of pairs' join, so that it needs no shuffle of its own


def same_person_pairs(rows: DataFrame, unit_col: str = "unit_id", id_col: str = "record_id", name_col: str = "name") -> DataFrame:
    """``id_a, id_b`` with ``id_a < id_b`` for all rows of one person in one unit."""
    found = people(rows, unit_col, id_col, name_col)
    a = found.select("unit_id", "person", F.col("record_id").alias("id_a"))
    b = found.select("unit_id", "person", F.col("record_id").alias("id_b"))
    return a.join(b, ["unit_id", "person"]).where("id_a < id_b").select("id_a", "id_b")
