"""Sentence boundaries across languages and scripts, in SQL expressions alone.

Marks that don't end a sentence (in decimals, addresses, initials, abbreviations, quotations and brackets) are masked by
private-use characters, one for one, so that positions stay what they are. Boundaries are then set by the terminators of
each script, the text is split there, and the masked marks are put back. Everything is a chain of JVM regular expressions
within one row: no shuffle, no Python. No pattern goes over a stretch of text more than a fixed number of times, however
long quotations, brackets, addresses and sentences are, so the time grows in proportion to the text; and a pattern only runs
on texts that have the mark it is about.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The private-use characters. One for each mark that is masked, one for each mark of a pair, and boundaries.
_MASKS = {".": "\ue001", "!": "\ue002", "?": "\ue003", ";": "\ue004", "。": "\ue005", "！": "\ue006", "？": "\ue007", "।": "\ue008", "؟": "\ue009", "॥": "\ue00a", "｡": "\ue00b", "۔": "\ue00c", "\u037e": "\ue00d"}
_BLANK, _CUT, _GAP, _TAB, _DOTS, _ASKS, _ASKS2 = "\ue014", "\ue015", "\ue016", "\ue017", "\ue018", "\ue019", "\ue01a"
_MASKED = "\ue001-\ue00d"
_MARK = r"[.!?;。！？।؟॥｡۔\u037e]"

# Quotation marks and brackets that belong together, an opening one with each that may close it.
_QUOTES = (("„", "“"), ("„", "”"), ("‚", "‘"), ("‚", "’"), ("“", "”"), ("«", "»"), ("‹", "›"), ("「", "」"), ("『", "』"), ("《", "》"))
_BRACKETS = (("(", ")"), ("（", "）"), ("[", "]"), ("【", "】"))
_OPENS = {pair: chr(0xE020 + i) for i, pair in enumerate((*_QUOTES, ('"', '"'), ("‘", "’")))}
_CLOSES = {pair: chr(0xE030 + i) for i, pair in enumerate(_OPENS)}
#: Closing marks of quotations that were announced by a colon or comma.
_TOLD = {pair: chr(0xE040 + i) for i, pair in enumerate(_OPENS)}
_LEFTS = {pair: chr(0xE050 + i) for i, pair in enumerate(_BRACKETS)}
_RIGHTS = {pair: chr(0xE058 + i) for i, pair in enumerate(_BRACKETS)}
_OPEN, _CLOSED, _TOLD_CLOSE, _LEFT, _RIGHT = "\ue020-\ue02f", "\ue030-\ue03f", "\ue040-\ue04f", "\ue050-\ue057", "\ue058-\ue05f"
_CLOSE = _CLOSED + _TOLD_CLOSE
_BACK = (
    {hidden: mark for mark, hidden in _MASKS.items()}
    | {hidden: pair[end] for table, end in ((_OPENS, 0), (_CLOSES, 1), (_TOLD, 1), (_LEFTS, 0), (_RIGHTS, 1)) for pair, hidden in table.items()}
    | {_BLANK: "\n", _GAP: " ", _TAB: "\t", _DOTS: ".", _ASKS: ";", _ASKS2: "\u037e"}
)

# Abbreviations that don't end a sentence when something follows, by language; with a full stop after each.
_BEFORE_NAMES = (
    "Dr Dra Drs Prof Profs Mr Mrs Ms Mx St Ste Sr Sra Srta Sres Pr Mme Mmes Mlle MM Hr Hrn Fr Frl Dipl Ing Mag Univ Rev Hon Gen Col Capt Lt Sgt Gov Messrs EE "
    "cf Cf vgl Vgl bzw inkl evtl sog vs approx Approx ca Ca resp spec esp incl av avda pza dpto Dpto "
    "Проф проф Доц доц Акад акад им Им ст преп гл ул пр ред изд см См ср Ср г-н г-жа д-р тыс млн млрд "
    "κ κα Κ Κα δρ Δρ καθ Καθ Βλ βλ πρβλ λ.χ π.χ δηλ"
)
_BEFORE_NUMBERS = (
    "No Nos no nos Nr Nrn Num num núm Núm vol Vol vols Bd Bde Abschn Abs Kap Art art Artikel Fig Figs fig figs Sect Sec sect sec Ch ch chap Chap cap Cap Eq eq Tab tab Abb p pp P S s pág págs Pág n N nº Nº "
    "с С стр рис Рис табл гл п пп разд № σελ Σελ κεφ Κεφ αρ Αρ παρ ص ed éd App app Ver ver v c ff geb Jg H Aufl"
)
_PAIRED = "p.ex p.ej z.B z.T d.h u.a u.U i.d.R o.ä i.e e.g т.е т.к и.о п.χ π.χ a.k.a U.E"
_PAIRED_LETTERS = "|".join(x.replace(".", rf"[.{_MASKS['.']}]\s?") for x in _PAIRED.split())
_PAIRED_FIRST = "|".join(f"{a}(?=\\.\\s?{b})" for x in _PAIRED.split() for a, b in zip(x.split("."), x.split(".")[1:], strict=False))
_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Jahrgang|Jahrestag|Semester|Auflage|Sitzung|Kapitel|Band|Klasse|Geburtstag|Platz|Stock|Woche|Tag"
_ARTICLES = "der|die|das|dem|den|des|im|am|vom|zum|zur|beim|ins|jeder|jede|jedes|dieser|diese|dieses|ein|einem|einen"


def _words(names: str) -> str:
    return "|".join(w.replace(".", r"\.") for w in sorted(names.split(), key=len, reverse=True))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _where(value: Column, has: str | tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """``change(value)`` for texts that contain any of the given strings, the others as they are."""
    any_of = (has,) if isinstance(has, str) else has
    return _bound(value, lambda v: F.when(reduce(lambda a, b: a | b, (F.contains(v, F.lit(h)) for h in any_of)), change(v)).otherwise(v))


def _flagged(text: Column, opening: str, closing: str) -> Column:
    """A flag before every mark between the two; the search only ever starts at an opening mark or where it left off."""
    thai_space = r"[ \t](?<=[\u0e00-\u0e7f][ \t])"
    return F.regexp_replace(text, rf"((?:[{opening}]|(?!\A)\G)[^{closing}{_BLANK}]*?)(?<!{_CUT})({_MARK}|{thai_space})", "$1" + _CUT + "$2")


def _paired(text: Column, pair: tuple[str, str], opening: str, closing: str, exclude: str) -> Column:
    """An opening mark with the next closing one; a stretch without either is passed once."""
    a, b = ("\\" + x if x in "[]()" else x for x in pair)
    return _where(text, pair[0], lambda v: F.regexp_replace(v, rf"{a}([^{exclude}{_BLANK}]++){b}", f"{opening}$1{closing}"))


def _inside(text: Column) -> Column:
    """Quotation marks and brackets that belong together become private-use characters, and marks inside are flagged."""
    for pair in _BRACKETS:
        a, b = ("\\" + x if x in "[]()" else x for x in pair)
        text = _paired(text, pair, _LEFTS[pair], _RIGHTS[pair], a + b)
    text = _where(text, tuple(_LEFTS.values()), lambda v: _flagged(v, _LEFT, _RIGHT))
    for pair in _QUOTES:
        closers = "".join(b for a, b in _QUOTES if a == pair[0])
        text = _paired(text, pair, _OPENS[pair], _CLOSES[pair], pair[0] + closers)
    straight, single = ('"', '"'), ("‘", "’")
    text = _where(text, '"', lambda v: F.regexp_replace(v, rf"\"(?<![^\s(\[{_LEFT}{_OPEN}—–:：-]\")(?!\s)([^\"{_BLANK}]++)(?<!\s)\"(?![\p{{L}}\p{{N}}])", f"{_OPENS[straight]}$1{_CLOSES[straight]}"))
    text = _where(text, "‘", lambda v: F.regexp_replace(v, rf"‘(?<![^\s(\[{_LEFT}{_OPEN}]‘)(?!\s)([^‘{_BLANK}]+?)’(?![\p{{L}}\p{{N}}])", f"{_OPENS[single]}$1{_CLOSES[single]}"))
    return _where(text, tuple(_OPENS.values()), lambda v: _announced(_flagged(v, _OPEN, _CLOSE)))


def _announced(text: Column) -> Column:
    """The closing marks of quotations announced by a colon or comma, told apart from the others."""
    flagged = F.regexp_replace(text, rf"([:：,，]\s{{0,2}}[{_OPEN}][^{_OPEN}{_CLOSE}]*+)(?=[{_CLOSE}])", "$1" + _DOTS)
    return _where(flagged, _DOTS, lambda v: reduce(lambda t, pair: F.replace(t, F.lit(_DOTS + _CLOSES[pair]), F.lit(_TOLD[pair])), _TOLD, v))


def _unflagged(text: Column) -> Column:
    for mark, hidden in _MASKS.items():
        text = F.replace(text, F.lit(_CUT + mark), F.lit(hidden))
    return F.replace(F.replace(text, F.lit(_CUT + " "), F.lit(_GAP)), F.lit(_CUT + "\t"), F.lit(_TAB))


def _full_stops(t: Column) -> Column:
    """Full stops that end nothing."""
    stop = _MASKS["."]
    # A full stop right before a character other than white space or a closing mark: decimals, addresses, inner dots.
    t = F.regexp_replace(t, rf"\.(?=[^\s{_CLOSE}{_RIGHT}{_BLANK}.…\"'”’»\])])", stop)
    # An ellipsis of dots ends nothing.
    t = _where(t, "..", lambda v: F.regexp_replace(v, r"\.(?:(?<=\.\.)|(?=\.))", _DOTS))
    t = F.regexp_replace(t, rf"\.(?=\s?\p{{L}})(?<=(?<![\p{{L}}\p{{M}}\p{{N}}])(?=\p{{L}}{{1,3}}\.\s)(?:{_PAIRED_FIRST})\.)", stop)
    t = _where(t, stop, lambda v: F.regexp_replace(v, rf"\.(?<=(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{_PAIRED_LETTERS})\.)", stop))
    t = F.regexp_replace(t, rf"\.(?=\s)(?<=(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{_words(_BEFORE_NAMES)})\.)|\.(?=\s\p{{N}})(?<=(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{_words(_BEFORE_NUMBERS)})\.)", stop)
    # Initials; a single letter after other letters with full stops (U.K.) may end a sentence.
    t = F.regexp_replace(t, rf"\.(?=\s\s?\p{{Lu}})(?<=(?<![\p{{L}}\p{{M}}\p{{N}}.{stop}])\p{{Lu}}\.)", stop)
    # Scripts in which a full stop only abbreviates.
    t = F.regexp_replace(t, r"\.(?:(?<=[ऀ-෿฀-๿]\.)|(?<=(?<![\p{L}\p{M}])[ء-ي]\.))", stop)
    # German ordinals.
    return F.regexp_replace(t, rf"\.(?=\s\p{{Lu}})(?<=\d\.)(?:(?<=(?<!\p{{L}})(?i:{_ARTICLES})\s\d{{1,3}}\.)|(?<=(?<!\d)\d{{1,2}}\.)(?=\.?\s(?:{_MONTHS})\b))", stop)


def _greek_questions(text: Column) -> Column:
    """A semicolon is a question mark where a Greek letter stands before it in its stretch; each stretch is passed once."""
    ended = F.regexp_replace(text, r"([Ͱ-ͽͿ-Ͽἀ-῿][^;\u037e.!\n]*+)", "$1" + _CUT)
    for mark, asks in ((";", _ASKS), ("\u037e", _ASKS2)):
        ended = F.replace(ended, F.lit(_CUT + mark), F.lit(asks))
    return F.replace(ended, F.lit(_CUT), F.lit(""))


def mask(text: Column) -> Column:
    """The text with every mark masked that doesn't end a sentence; as many code points as before."""
    t = _where(text, "\n", lambda v: F.regexp_replace(v, r"\n(?=[^\S\n]*\n)", _BLANK))
    t = _where(_inside(t), _CUT, _unflagged)
    in_address = rf"((?:\b(?:www|https?)|(?!\A)\G)[^\s?!]*+)[?!](?=\S)"
    t = _where(t, ("www", "http"), lambda v: F.regexp_replace(v, in_address, "$1" + _MASKS["?"]))
    t = _where(t, "=", lambda v: F.regexp_replace(v, r"[?!](?=[\p{L}\p{N}_]++=)", _MASKS["?"]))
    t = _where(t, (";", "\u037e"), lambda v: F.when(v.rlike("[Ͱ-Ͽἀ-῿]"), _greek_questions(v)).otherwise(v))
    return _where(t, ".", _full_stops)


_CLOSERS = rf"[{_CLOSE}{_RIGHT}\"'”’»›)\]）」』】]"
_STARTS = rf"(?:[\p{{Lu}}\p{{Lt}}\p{{Nd}}\p{{Lo}}{_OPEN}{_LEFT}¿¡\"'“«‹‘„(\[]|\p{{Ll}}\p{{Lu}}|[–—•*-]\s?[\p{{Lu}}\p{{Lo}}])"
_NO_GO = rf"(?!\s?[,;:、，；：{_ASKS}])"
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"


def _boundaries() -> str:
    """What a sentence ends with, closing marks included; letters and digits, at which nothing ends, are passed over at once."""
    low = r"(?!\s*\p{Ll}(?!\p{Lu}))"
    return r"(?=[^ ,/-9a-zA-Z\u00a0-\u02ff\u0400-\u052f\u0e80-\u2fff\u3040-\ud7ff])(?:" + "|".join(
        (
            # full-width terminators need no space after them
            rf"[。！？｡](?:[。！？｡!?…]*){_CLOSERS}*+{_NO_GO}",
            # full stops need one, and something that starts a sentence
            rf"\.{_CLOSERS}*+(?=\s+{_STARTS}|\s*$|\s*{_BLANK})",
            # marks that stand for themselves in their script
            rf"[।॥۔]{_CLOSERS}*+{_NO_GO}",
            rf"[!?؟]+{_CLOSERS}*+(?=\s|$|{_BLANK}|(?<=[{_CJK}][!?])[{_CJK}]){_NO_GO}{low}",
            # in Greek the semicolon asks
            rf"[{_ASKS}{_ASKS2}]{_CLOSERS}*+(?=\s|$|{_BLANK}){low}",
            # a quotation that ends in a mark ends the sentence it was announced in ...
            rf"[{_TOLD_CLOSE}](?<=[{_MASKED}]\s?[{_TOLD_CLOSE}]){_NO_GO}(?!\s?[とって라고다]){low}(?!\s?[—–])",
            # ... or, in scripts with capitals, before a capital or another opening mark
            rf"[{_CLOSE}](?<=[^\s{_CJK}][{_MASKED}]\s?[{_CLOSE}])(?=\s+(?:[\p{{Lu}}¿¡{_OPEN}]|\p{{Ll}}\p{{Lu}}))",
            # in Thai a space ends a sentence, unless a numeral or Latin letter touches it
            rf"[฀-๿](?=\s+[฀-๿{_OPEN}{_LEFT}])",
            rf"[{_CLOSE}{_RIGHT}](?=\s+[฀-๿])",
            # a blank line ends everything
            _BLANK,
        )
    ) + ")"


def pieces(text: Column) -> Column:
    """Array of the masked text's pieces, each with one sentence and the white space around it."""
    cut = F.regexp_replace(mask(text), _boundaries(), "$0" + _CUT)
    return F.split(cut, _CUT, -1)


def restored(piece: Column) -> Column:
    """A piece with its masked marks put back."""
    return F.translate(piece, "".join(_BACK), "".join(_BACK.values()))


# White space around sentences.
_WHITE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u200b\ufeff" + _BLANK
_BLOCK = 64


def _starts(lengths: Column) -> Column:
    """Running sums of ``lengths``, each without itself, by blocks, so that no long array is built again for every entry."""
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def running(xs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")))["out"]

    def from_blocks(xs: Column) -> Column:
        blocks = F.transform(numbers(F.ceil(F.size(xs) / _BLOCK).cast("int")), lambda k: F.slice(xs, k * _BLOCK + 1, F.lit(_BLOCK)))
        sums = lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x)
        return _bound(blocks, lambda bs: _bound(running(F.transform(bs, sums)), lambda at: F.flatten(F.transform(bs, lambda b, k: F.transform(running(b), lambda x: x + F.get(at, k))))))

    return _bound(lengths, from_blocks)


def sentence_spans(text: Column) -> Column:
    """Array of (start, sent_end, piece): code point offsets of the sentence's first character and after its last, and the masked piece."""

    def spans(parts: Column) -> Column:
        starts = _starts(F.transform(parts, F.length))
        whole = F.transform(
            F.arrays_zip(parts.alias("p"), starts.alias("at")),
            lambda x: F.struct((x["at"] + F.length(x["p"]) - F.length(F.ltrim(x["p"], F.lit(_WHITE)))).alias("start"), (x["at"] + F.length(F.rtrim(x["p"], F.lit(_WHITE)))).alias("sent_end"), x["p"].alias("piece")),
        )
        return F.filter(whole, lambda x: x["start"] < x["sent_end"])

    return _bound(pieces(text), spans)


def sentences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sent_no, start, sent_end, sentence`` for every sentence of every document.

    Null, empty and blank texts have no sentences. Private-use characters of the range used for masking that a text brings
    along count as letters; such a text's sentences are cut out of it by their offsets. Texts that repeat come out for each row.
    """
    used = "".join(_BACK) + _CUT
    own = F.when(F.col(text_col).rlike("[\ue001-\ue05f]"), F.col(text_col))
    text = F.when(own.isNotNull(), F.translate(F.col(text_col), used, "\ue060" * len(used))).otherwise(F.col(text_col))
    rows = documents.select(F.col(id_col).alias("doc_id"), own.alias("_own"), F.posexplode(sentence_spans(text)).alias("sent_no", "_s"))
    cut = F.col("_own").substr(F.col("_s.start") + 1, F.col("_s.sent_end") - F.col("_s.start"))
    whole = F.rtrim(F.ltrim(restored(F.col("_s.piece")), F.lit(_WHITE)), F.lit(_WHITE))
    return rows.select("doc_id", (F.col("sent_no") + 1).alias("sent_no"), "_s.start", "_s.sent_end", F.when(F.col("_own").isNotNull(), cut).otherwise(whole).alias("sentence"))
