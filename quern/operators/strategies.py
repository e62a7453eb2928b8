"""Seven text perturbations at three levels, as columns, over every target field of a sample.

A strategy finds its eligible places in each clean text once, draws k of them (one from each of k even strata, by arithmetic on the
row's seed) and turns each into an edit.  Budgets follow from the number of eligible places and the length of the text, for each field by itself; ``vis`` draws over all
fields together, and the repeats change one field only at the low level.  Nothing is shuffled.

Per-row work (places, the text as fixed-width bytes) is done below the point where levels become rows; the perturbed texts and the operations are made from drawn
places above it, each only where a caller reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions.edits import op
from ..functions.keys import mix, mix_numbers, row_seed, sql_mix, strata
from ..functions.plan import opaque
from ..functions.segment import IS_WORD, pattern, span, tokens
from ..functions.text import UNIT, has_two_visible
from ..schema import LEVELS, STRATEGIES
from .calls import illegal_targets

BASE_SEED = 42
# fixed values: percent of eligible places, target edits, greatest percent of the text, by level
RATE = {"homo": (5, 8, 12), "del": (4, 7, 10), "add_noise": (5, 8, 12), "swap": (5, 10, 12)}
TARGET = {"homo": (1, 2, 3), "del": (1, 2, 2), "add_noise": (1, 2, 3), "swap": (1, 2, 3), "red_char": (1, 1, 2), "red_word": (1, 1, 2), "vis": (1, 2, 3)}
MOST = {"homo": (6, 10, 14), "del": (6, 9, 12), "add_noise": (8, 12, 16)}
VIS_EVERY = (240, 200, 160)
LEAST_LENGTH = 20
#: Strategies that draw over all fields together, and those that change one field only at the low level.
JOINT, ONE_AT_LOW = ("vis",), ("red_char", "red_word")
#: Own small tables: look-alikes and sound-alikes for Han and Latin script, and the noise alphabet.
LOOK_ALIKE = {"第": "苐", "末": "未", "土": "士", "日": "曰", "己": "已", "人": "入", "大": "太", "钓": "钩", "鱼": "鱻", "漂": "飘", "l": "1", "o": "0", "e": "3", "s": "5", "b": "6", "g": "9"}
SOUND_ALIKE = {"在": "再", "的": "得", "他": "她", "是": "事", "有": "友", "作": "做", "c": "k", "f": "v", "i": "y", "z": "s", "d": "t", "p": "b"}
# fixed value: function words that look-alikes never touch
STOP = "我你他她它的是不了在也和与或有无这那其为被将把从对及而都很最怎"
NOISE = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Salts of the numbers that are drawn for other things than places.
SALT_NOISE, SALT_FIELD, SALT_PARITY = 1, 2, 3


def at(values: tuple[int, ...], level: Column) -> Column:
    out = F.lit(values[0])
    for name, v in zip(LEVELS[1:], values[1:], strict=True):
        out = F.when(level == name, v).otherwise(out)
    return out


def swap_rate(level: Column, units: Column) -> Column:
    """Percent of units that take part in swaps: the level's rate, but no more than half again the target over all units."""
    return F.least(at(RATE["swap"], level).cast("double"), 150.0 * at(TARGET["swap"], level) / F.greatest(units, F.lit(1)))


def budget(strategy: str, level: Column, n: Column, length: Column) -> Column:
    """Edits to make, never more than the eligible places."""
    target = at(TARGET[strategy], level)
    if strategy == "vis":
        return F.least(n, target + F.floor(length / at(VIS_EVERY, level)).cast("int"))
    if strategy == "swap":
        return F.least(n, target, F.greatest(F.lit(1), F.floor(2 * n * swap_rate(level, 2 * n) / 100).cast("int")))
    if strategy in MOST:
        most = F.greatest(F.lit(1), F.floor(F.greatest(length, F.lit(LEAST_LENGTH)) * at(MOST[strategy], level) / 100).cast("int"))
        return F.least(n, F.greatest(target, F.floor(n * at(RATE[strategy], level) / 100).cast("int")), most)
    return F.least(n, target)


def rate_count(total: Column, rate: float) -> Column:
    """A share of a total as a whole number, halves to even, one at least."""
    return F.greatest(F.lit(1), F.bround(total * rate)).cast("long")


def map_char(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def _one_of(table: dict[str, str], drop: str = "") -> str:
    return "[" + "".join(k for k in table if k not in drop) + "]"


#: Stands for characters outside a class; a text's own zero characters are in no class.
_OUT = "\0"


def _mask(text: Column, cls: str) -> Column:
    """The text's characters, with _OUT for each that is outside the class: one pattern over the whole text instead of one for each character."""
    inner = cls[1:-1] if cls.startswith("[") else cls
    return F.split(F.regexp_replace(text, f"(?s)[^{inner}]", _OUT), "")


def _where(items: Column, test: Callable[[Column, Column], Column]) -> Column:
    return F.filter(F.transform(items, lambda c, i: F.when(test(c, i), i)), lambda x: x.isNotNull())


def _in_class(text: Column, cls: str) -> Column:
    # split() of '' has one empty string, which is in no class
    return _where(_mask(text, cls), lambda c, i: (c != _OUT) & (c != ""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _swap_places(text: Column, unit: str) -> Column:
    """Places where two unlike characters of the class stand side by side."""

    def places(mask: Column) -> Column:
        after = lambda i: F.coalesce(F.get(mask, i + 1), F.lit(_OUT))
        return _where(mask, lambda c, i: (c != _OUT) & (c != "") & (after(i) != _OUT) & (after(i) != c))

    return _let(_mask(text, unit), places)


@dataclass(frozen=True)
class Strategy:
    name: str
    #: Kind of operation, unit of its trace, and characters of the text that an edit of a place p covers: those from p + skip on.
    kind: str
    unit: str
    skip: int
    width: int
    #: (text, unit pattern) -> eligible places, ascending
    places: Callable[[Column, str], Column]
    #: (characters covered, seed, number of the edit) -> what replaces them or is put in
    new: Callable[[Column, Column, Column], Column]
    #: What the trace says of every edit.
    metadata: tuple[tuple[str, str], ...] = ()
    #: Unit pattern -> the class of eligible characters, for strategies whose edits grow with the text; None for those that make a few.
    cls: Callable[[str], str] | None = None


def _noise(old: Column, seed: Column, j: Column) -> Column:
    return F.substring(F.lit(NOISE), (mix(seed, j, SALT_NOISE) % len(NOISE)).cast("int") + 1, F.lit(1))


CHAR_STRATEGIES = {s.name: s for s in [
    Strategy("homo", "replace", "word", 0, 1, lambda t, unit: _in_class(t, _one_of(SOUND_ALIKE)), lambda old, seed, j: map_char(old, SOUND_ALIKE), cls=lambda unit: _one_of(SOUND_ALIKE)),
    Strategy("vis", "replace", "char", 0, 1, lambda t, unit: _in_class(t, _one_of(LOOK_ALIKE, STOP)), lambda old, seed, j: map_char(old, LOOK_ALIKE), (("candidate_count", "1"),)),
    Strategy("del", "delete", "char", 0, 1, lambda t, unit: _in_class(t, unit), lambda old, seed, j: F.lit(""), cls=lambda unit: unit),
    Strategy("swap", "replace", "char", 0, 2, _swap_places, lambda old, seed, j: F.reverse(old)),
    Strategy("add_noise", "insert", "noise", 1, 0, lambda t, unit: _in_class(t, unit), _noise, cls=lambda unit: unit),
    Strategy("red_char", "duplicate", "char", 0, 1, lambda t, unit: _in_class(t, unit), lambda old, seed, j: old, (("repeat_count", "1"),)),
]}
#: Strategies with many edits, whose places are the characters of a class: an Arrow function makes their texts.
MANY = [s.name for s in CHAR_STRATEGIES.values() if s.cls]


@F.udf(StringType(), useArrow=True)
def edit_many(strategy, text, mask, seed, k, first):
    """The text with k of its places edited, drawn as by ``strata``: Spark's functions have no cheap cut at a place of a long text, and this is done for each tenth character or so."""
    if text is None:
        return None
    import numpy as np

    points = lambda t: np.frombuffer(t.encode("utf-32-le"), "<u4")
    text, places = points(text), np.flatnonzero(points(mask))
    j, n = np.arange(k, dtype=np.int64), len(places)
    lo, hi = j * n // k, (j + 1) * n // k
    at = places[lo + mix_numbers(seed, first + j) % np.maximum(hi - lo, 1)]
    if strategy == "del":
        out = np.delete(text, at)
    elif strategy == "add_noise":
        out = np.insert(text, at + 1, points(NOISE)[mix_numbers(seed, first + j, SALT_NOISE) % len(NOISE)])
    else:
        out = text.copy()
        out[at] = points("".join(SOUND_ALIKE.get(c, c) for c in text[at].tobytes().decode("utf-32-le")))
    return out.tobytes().decode("utf-32-le")


def places_of(strategy: str, text: Column, unit: str, words: Column | None = None) -> Column:
    """Eligible places: characters, or numbers of tokens (``words``) for ``red_word``."""
    if strategy == "red_word":
        return _where(tokens(text) if words is None else words, lambda w, i: w.rlike(IS_WORD[unit]))
    p = CHAR_STRATEGIES[strategy].places(text, UNIT[unit])
    return F.when(has_two_visible(text), p).otherwise(_none()) if strategy == "red_char" else p


def mask_of(strategy: str, text: Column, unit: str) -> Column:
    """For strategies of MANY the text with _OUT for each character that is no place."""
    return F.regexp_replace(text, f"(?s)[^{CHAR_STRATEGIES[strategy].cls(UNIT[unit]).strip('[]')}]", _OUT) if strategy in MANY else F.lit(None).cast("string")


def _by(strategy: str | Column, value: Callable[[str], Column]) -> Column:
    """The strategy's value; of a column of strategies only the branch of a row's own is computed."""
    if isinstance(strategy, str):
        return value(strategy)
    out = F.lit(None)
    for name in STRATEGIES:
        out = F.when(strategy == name, value(name)).otherwise(out)
    return out


def _is(strategy: str | Column, names: Sequence[str]) -> Column:
    return F.lit(strategy in names) if isinstance(strategy, str) else F.coalesce(strategy.isin(*names), F.lit(False))


def _none() -> Column:
    return F.array().cast("array<int>")


def works(strategy: str, text: Column, unit: str = "letter") -> Column:
    """Whether the strategy has an eligible place in the text, so an edit to make at every level; without looking for all places."""
    has = text.rlike(UNIT[unit])
    return {
        "homo": text.rlike(_one_of(SOUND_ALIKE)), "vis": text.rlike(_one_of(LOOK_ALIKE, STOP)), "del": has, "add_noise": has, "red_char": has & has_two_visible(text), "red_word": text.rlike(IS_WORD[unit]),
        "swap": text.rlike(f"({UNIT[unit]})(?!\\1){UNIT[unit]}"),
    }[strategy]


@dataclass
class _Field:
    """The columns of one field: its text, length, fixed-width bytes, tokens, mask, places, places to draw from and their number, edits to make, ranks drawn, drawn places.

    ``found``, ``from`` and ``drawn`` are empty for strategies of MANY, of which ``many`` is the text; only operations read ``places`` and ``at``, which all strategies have.
    """

    name: str
    x: int

    def __getattr__(self, kind: str) -> Column:
        return F.col(f"__{kind}{self.x}")

    def with_cut(self, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
        """``body`` of cut(start, n): n characters from ``start`` on, at a cost that doesn't grow with ``start``; a text with a byte order mark is cut as it is.

        The bytes are bound once: read from the row, they would be copied for every cut.
        """

        def bound(b: Column) -> Column:
            return body(lambda start, n: F.when(self.mark, F.substring(self.text, start + 1, n)).otherwise(F.decode(F.substring(b, start * 4 + 1, n * 4), "UTF-32")))

        return _let(self.bytes, bound)


def perturb(
    df: DataFrame, strategy: str | Column, text: str | Sequence[str] = "text_a", base_seed: int = BASE_SEED, unit: str = "letter", levels: Sequence[str] = LEVELS, targets: str | None = None, kind: str | None = None,
) -> DataFrame:
    """Each row at each level, made from the clean texts: adds level, seed, ops, change_count, corrupted, status, failure_reason.

    ``df`` needs dataset_name and sample_id.  ``text``: a field, or several; each operation names its field, and ``corrupted`` is a text, or a struct of all fields' texts (null
    where nothing is changed).  ``strategy``: a name, or a column of names.  ``targets`` and ``kind`` name columns with a row's target fields and kind of payload: other fields stay
    as they are, and rows with illegal target fields are INVALID.  Null texts and texts without an eligible place: NOT_APPLIED, no operations.
    """
    names, own = [text] if isinstance(text, str) else list(text), df.columns
    if unknown := set(levels) - set(LEVELS) or (set() if isinstance(strategy, Column) or strategy in STRATEGIES else {strategy}):
        raise ValueError(f"unknown level or strategy: {sorted(unknown)}")
    fields, rows = [_Field(n, x) for x, n in enumerate(names)], df
    invalid = F.size(illegal_targets(F.col(targets), F.col(kind))) > 0 if targets and kind else F.lit(False)
    rows = rows.withColumns({"__strategy": F.lit(strategy) if isinstance(strategy, str) else strategy, "__invalid": F.coalesce(invalid, F.lit(False))} | {f"__text{f.x}": F.coalesce(F.col(f.name), F.lit("")) for f in fields})
    chosen = strategy if isinstance(strategy, str) else F.col("__strategy")
    words, many = _is(chosen, ["red_word"]), _is(chosen, MANY)
    for f in fields:
        wanted = ~F.col("__invalid") & (F.coalesce(F.array_contains(F.col(targets), f.name), F.lit(False)) if targets else F.lit(True))
        rows = rows.withColumn(f"__tokens{f.x}", opaque(F.when(words, tokens(f.text))) if not isinstance(strategy, str) or strategy == "red_word" else F.lit(None))
        own_places = lambda names, f=f, wanted=wanted: F.coalesce(F.when(wanted & _is(chosen, names), _by(chosen, lambda n: places_of(n, f.text, unit, f.tokens) if n in names else _none())), _none())
        rows = rows.withColumns({f"__found{f.x}": opaque(own_places([n for n in STRATEGIES if n not in MANY])), f"__cut{f.x}": opaque(own_places(MANY))})
        rows = rows.withColumn(f"__mask{f.x}", opaque(F.when(wanted, _by(chosen, partial(mask_of, text=f.text, unit=unit)))))
        rows = rows.withColumns({f"__places{f.x}": F.when(many, f.cut).otherwise(f.found), f"__bytes{f.x}": opaque(F.encode(f.text, "UTF-32")), f"__mark{f.x}": opaque(F.contains(f.text, F.lit("\ufeff")))})
        rows = rows.withColumn(f"__able{f.x}", opaque(F.when(many, F.coalesce(F.length(F.replace(f.mask, F.lit(_OUT), F.lit(""))), F.lit(0)))))
    # levels become rows only now, so that what they share is computed once
    level, seed = F.col("level"), F.col("seed")
    rows = rows.withColumn("__level", F.explode(F.array(*map(F.lit, levels)))).drop(*[c for c in own if c == "level"]).withColumnRenamed("__level", "level")
    rows = rows.withColumn("seed", opaque(row_seed(F.lit(base_seed), F.col("dataset_name"), F.col("sample_id"), F.col("__strategy"), level)))
    swap = _is(chosen, ["swap"])
    rows = rows.withColumn("__parity", opaque(mix(seed, F.lit(0), SALT_PARITY) % 2))
    parity = F.col("__parity")
    one = lambda f, p: F.filter(f.found, lambda x: x % 2 == p)  # noqa: E731  places of one parity make disjoint pairs
    swaps = not isinstance(strategy, str) or strategy == "swap"
    rows = rows.withColumns({f"__from{f.x}": opaque(F.when(swap, F.when(F.exists(f.found, lambda x: x % 2 == parity), one(f, parity)).otherwise(one(f, 1 - parity))).otherwise(f.found)) if swaps else f.found for f in fields})
    rows = rows.withColumns({f"__size{f.x}": F.when(many, f.able).otherwise(F.size(f.__getattr__("from"))) for f in fields})
    size = lambda f: f.size
    edits = lambda n, length: _by(chosen, lambda name: budget(name, level, n, length))
    joint, single = _is(chosen, JOINT), _is(chosen, ONE_AT_LOW) & (level == LEVELS[0])
    before = [sum((size(g) for g in fields[: f.x]), F.lit(0)) for f in fields]
    if len(fields) > 1:
        whole = edits(sum((size(f) for f in fields[1:]), size(fields[0])), sum((F.length(f.text) for f in fields[1:]), F.length(fields[0].text)))
        able = [(size(f) > 0).cast("int") for f in fields]
        rank = [sum(able[: f.x], F.lit(0)) for f in fields]
        pick = mix(seed, F.lit(0), SALT_FIELD) % F.greatest(sum(able, F.lit(0)), F.lit(1))
        rows = rows.withColumn("__all", opaque(F.when(joint, strata(seed, sum((size(f) for f in fields[1:]), size(fields[0])), whole)).otherwise(_none())))
        inside = lambda f: F.filter("__all", lambda r: (r >= before[f.x]) & (r < before[f.x] + size(f)))
        count = {f.x: F.when(joint, F.size(inside(f))).when(single & (rank[f.x] != pick), 0).otherwise(edits(size(f), F.length(f.text))) for f in fields}
    else:
        count = {0: edits(size(fields[0]), F.length(fields[0].text))}
    rows = rows.withColumns({f"__count{f.x}": opaque(F.coalesce(count[f.x], F.lit(0)).cast("int")) for f in fields})
    first = [sum((g.count for g in fields[: f.x]), F.lit(0)) for f in fields]

    def ranks(f: _Field) -> Column:
        own_ranks = strata(seed, size(f), f.count, first[f.x])
        return F.when(joint, F.transform(inside(f), lambda r: (r - before[f.x]).cast("int"))).otherwise(own_ranks) if len(fields) > 1 else own_ranks

    at_ranks = lambda f, places: F.transform(f.ranks, lambda r: F.get(places, r))
    rows = rows.withColumns({f"__ranks{f.x}": opaque(ranks(f)) for f in fields})
    rows = rows.withColumns({f"__drawn{f.x}": opaque(at_ranks(f, f.__getattr__("from"))) for f in fields} | {f"__at{f.x}": opaque(F.when(many, at_ranks(f, f.cut)).otherwise(at_ranks(f, f.__getattr__("from")))) for f in fields})
    if not isinstance(strategy, str) or strategy in MANY:
        made_of = lambda f: edit_many(F.col("__strategy"), *[F.when(many & (f.count > 0), c) for c in (f.text, f.mask)], seed, f.count, first[f.x])
        rows = rows.withColumns({f"__many{f.x}": opaque(made_of(f)) for f in fields})
    total = sum((f.count for f in fields[1:]), fields[0].count).cast("long")
    texts = [F.when(f.count > 0, _text(chosen, f, seed, first[f.x])).otherwise(F.col(f.name)) for f in fields]
    out = texts[0] if isinstance(text, str) else F.struct(*[t.alias(n) for t, n in zip(texts, names, strict=True)])
    ops = F.concat(*[_ops(chosen, f, seed, first[f.x]) for f in fields])
    status = F.when(F.col("__invalid"), "INVALID").when(total > 0, "APPLIED").otherwise("NOT_APPLIED")
    reason = F.when(F.col("__invalid"), "illegal_target_field").when(total == 0, "no_eligible_place")
    made = {"ops": ops, "change_count": total, "corrupted": F.when(total > 0, out), "status": status, "failure_reason": reason}
    return rows.select(*[F.col(c) for c in own if c not in {"level", "seed", *made}], "level", "seed", *[v.alias(n) for n, v in made.items()])


def _edit(s: Strategy, cut: Callable[[Column, Column], Column], p: Column, seed: Column, j: Column) -> tuple[Column, Column]:
    """(characters covered, characters put in their place or after them) of an edit at ``p``."""
    old = cut(p + s.skip, F.lit(s.width)) if s.width else F.lit("")
    return old, s.new(old, seed, j)


def _text(strategy: str | Column, f: _Field, seed: Column, first: Column) -> Column:
    """The field's text with its drawn places edited: kept stretches and edits are joined once."""

    def made(name: str) -> Column:
        if name == "red_word":
            return F.array_join(F.transform(f.tokens, lambda w, i: F.when(F.array_contains(f.drawn, i), F.concat(w, w)).otherwise(w)), "")
        s = CHAR_STRATEGIES[name]
        if s.cls:
            return f.many

        def joined(cut: Callable[[Column, Column], Column]) -> Column:
            def part(p: Column, j: Column) -> Column:
                last = F.coalesce(F.get(f.drawn, j - 1) + (s.skip + s.width), F.lit(0))
                old, new = _edit(s, cut, p, seed, first + j)
                return F.concat(cut(last, p + s.skip - last), *([old, new] if s.kind == "duplicate" else [new]))

            end = F.get(f.drawn, F.size(f.drawn) - 1) + (s.skip + s.width)
            return F.concat(F.array_join(F.transform(f.drawn, part), ""), cut(end, F.length(f.text) - end))

        return f.with_cut(joined)

    return _by(strategy, made)


def _ops(strategy: str | Column, f: _Field, seed: Column, first: Column) -> Column:
    """Operations of the field's drawn places, ascending, numbered on from ``first``."""
    field = F.lit(f.name)

    def word(i: Column, j: Column) -> Column:
        start, end = span(f.tokens, i)
        meta = F.create_map(F.lit("candidate_count"), F.size(f.places).cast("string"))
        return op("duplicate", start, end, F.get(f.tokens, i), F.get(f.tokens, i), field=field, unit="word", index=first + j, metadata=meta)

    def made(name: str) -> Column:
        if name == "red_word":
            return F.transform(f.at, word)
        s = CHAR_STRATEGIES[name]
        meta = F.create_map(*[F.lit(x) for kv in s.metadata for x in kv]) if s.metadata else None

        def each(cut: Callable[[Column, Column], Column]) -> Column:
            def one(p: Column, j: Column) -> Column:
                old, new = _edit(s, cut, p, seed, first + j)
                return op(s.kind, p + s.skip, p + (s.skip + s.width), old, new, field=field, unit=s.unit, index=first + j, metadata=meta)

            return F.transform(f.at, one)

        return f.with_cut(each)

    return _by(strategy, made)


def uniform_choice(df: DataFrame, key: str, n: Column, k: int, seed: Column) -> DataFrame:
    """(key, pos): k of the places below ``n`` for each key, every k-subset equally likely: those of least hash.

    Rows keep their own k places before keys meet, so that k places of a row are sorted, not all.  Hashes are compared as bytes, which is the order of their digits.
    """
    hashed = lambda p: F.struct(F.unhex(F.sha2(F.concat_ws("|", seed, p), 256)).alias("hash"), p.alias("pos"))
    places = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    each = df.select(key, F.inline(F.slice(F.sort_array(F.transform(places, hashed)), 1, k)))
    w = Window.partitionBy(key).orderBy("hash", "pos")
    return each.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).select(key, "pos")


# -- the same in SQL, for checks by another engine ----------------------------------------------


def sql_case(values: tuple[int, ...]) -> str:
    return "CASE level " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in zip(LEVELS, values, strict=True)) + " END"


def sql_budget(strategy: str) -> str:
    if strategy == "vis":
        return f"least(n, {sql_case(TARGET['vis'])} + len // {sql_case(VIS_EVERY)})"
    if strategy == "swap":
        return f"least(n, {sql_case(TARGET['swap'])}, greatest(1, floor(2 * n * least({sql_case(RATE['swap'])}::DOUBLE, 150.0::DOUBLE * {sql_case(TARGET['swap'])} / greatest(2 * n, 1)) / 100)::BIGINT))"
    if strategy in MOST:
        return f"least(n, greatest({sql_case(TARGET[strategy])}, (n * {sql_case(RATE[strategy])}) // 100), greatest(1, (greatest(len, {LEAST_LENGTH}) * {sql_case(MOST[strategy])}) // 100))"
    return f"least(n, {sql_case(TARGET[strategy])})"


SINGLE_SQL = "SELECT doc_id::VARCHAR AS sample_id, 'docs' AS dataset_name, 0 AS f, coalesce(text, '') AS t FROM documents"


def sql_steps(strategy: str, source: str = SINGLE_SQL, base_seed: int = BASE_SEED, unit: str = "letter") -> str:
    """CTEs up to ``p`` (sample_id, level, f, j, seed, pos: the drawn places), ``b`` (edits by field: k) and ``z`` (texts: o).  ``source``: sample_id, dataset_name, f (number of the field), t."""
    letter = f"regexp_matches(c, '{UNIT[unit]}')"
    head = f"""
d AS ({source}),
lv AS (SELECT unnest(['low', 'medium', 'high']) AS level),
s AS (SELECT DISTINCT sample_id, level, ('0x' || substr(sha256('{base_seed}|' || dataset_name || '|' || sample_id || '|{strategy}|' || level), 9, 8))::BIGINT & 2147483647 AS seed FROM d, lv),"""
    if strategy == "red_word":
        head += f"""
x AS (SELECT sample_id, f, unnest(w) AS c, unnest(range(len(w))) AS pos FROM (SELECT sample_id, f, regexp_extract_all(t, '{pattern()}') AS w FROM d)),"""
        test = f"regexp_matches(c, '{IS_WORD[unit]}')"
    else:
        head += """
c AS (SELECT sample_id, f, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS pos FROM d WHERE length(t) > 0),
x AS (SELECT *, lead(c) OVER (PARTITION BY sample_id, f ORDER BY pos) AS nx, lag(c) OVER (PARTITION BY sample_id, f ORDER BY pos) AS pv FROM c),"""
        test = {
            "homo": f"regexp_matches(c, '{_one_of(SOUND_ALIKE)}')", "vis": f"regexp_matches(c, '{_one_of(LOOK_ALIKE, STOP)}')", "del": letter, "add_noise": letter,
            "red_char": f"{letter} AND sample_id || '|' || f IN (SELECT sample_id || '|' || f FROM d WHERE length(regexp_replace(t, '[\\p{{C}}\\p{{Z}}]', '', 'g')) >= 2)",
            "swap": f"{letter} AND coalesce(regexp_matches(nx, '{UNIT[unit]}') AND nx <> c, false)",
        }[strategy]
    if strategy == "swap":
        head += f"""
e0 AS (SELECT x.sample_id, f, pos, level, {sql_mix("seed", "0", SALT_PARITY)} % 2 = pos % 2 AS mine FROM x JOIN s USING (sample_id) WHERE {test}),
e1 AS (SELECT *, bool_or(mine) OVER (PARTITION BY sample_id, f, level) AS any_mine FROM e0),
e AS (SELECT sample_id, f, level, pos, row_number() OVER (PARTITION BY sample_id, f, level ORDER BY pos) - 1 AS rank FROM e1 WHERE mine = any_mine),
m AS (SELECT sample_id, f, level, count(*) AS n FROM e GROUP BY ALL),"""
        using = "sample_id, f, level"
    else:
        head += f"""
e AS (SELECT sample_id, f, pos, row_number() OVER (PARTITION BY sample_id, f ORDER BY pos) - 1 AS rank FROM x WHERE {test}),
m AS (SELECT sample_id, f, count(*) AS n FROM e GROUP BY ALL),"""
        using = "sample_id, f"
    head += f"""
b0 AS (SELECT d.sample_id, d.f, s.level, seed, t, length(t) AS len FROM d JOIN s USING (sample_id)),
b1 AS (SELECT b0.*, coalesce(n, 0) AS n FROM b0 LEFT JOIN m USING ({using})),"""
    drawn = f"(j * n) // k + {sql_mix('seed', 'first + j')} % greatest(((j + 1) * n) // k - (j * n) // k, 1)"
    if strategy in JOINT:
        head += f"""
b2 AS (SELECT sample_id, level, seed, sum(n)::BIGINT AS n, sum(len)::BIGINT AS len FROM b1 GROUP BY ALL),
b3 AS (SELECT *, {sql_budget(strategy)} AS k, 0 AS first FROM b2),
r0 AS (SELECT sample_id, level, seed, {drawn} AS rank FROM (SELECT *, unnest(range(k)) AS j FROM b3)),
o0 AS (SELECT *, sum(n) OVER (PARTITION BY sample_id, level ORDER BY f) - n AS off FROM b1),
r AS (SELECT r0.sample_id, r0.level, r0.seed, o0.f, r0.rank - off AS rank, row_number() OVER (PARTITION BY r0.sample_id, r0.level ORDER BY r0.rank) - 1 AS j FROM r0 JOIN o0 ON r0.sample_id = o0.sample_id AND r0.level = o0.level AND r0.rank >= off AND r0.rank < off + o0.n),
b AS (SELECT b1.*, coalesce(k, 0) AS k FROM b1 LEFT JOIN (SELECT sample_id, level, f, count(*) AS k FROM r GROUP BY ALL) USING (sample_id, level, f)),"""
    else:
        k = sql_budget(strategy)
        if strategy in ONE_AT_LOW:
            k = f"CASE WHEN level = 'low' AND able > 1 AND nth <> {sql_mix('seed', '0', SALT_FIELD)} % able THEN 0 ELSE {k} END"
        head += f"""
b2 AS (SELECT *, count(*) FILTER (n > 0) OVER (PARTITION BY sample_id, level) AS able, coalesce(count(*) FILTER (n > 0) OVER (PARTITION BY sample_id, level ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth FROM b1),
b3 AS (SELECT *, {k} AS k FROM b2),
b AS (SELECT *, (sum(k) OVER (PARTITION BY sample_id, level ORDER BY f) - k)::BIGINT AS first FROM b3),
r AS (SELECT sample_id, level, f, seed, first + j AS j, {drawn} AS rank FROM (SELECT *, unnest(range(k)) AS j FROM b)),"""
    out = {
        "homo": _sql_map(SOUND_ALIKE), "vis": _sql_map(LOOK_ALIKE), "del": "''", "add_noise": f"c || substr('{NOISE}', ({sql_mix('seed', 'j', SALT_NOISE)} % {len(NOISE)} + 1)::INT, 1)", "red_char": "c || c", "red_word": "c || c", "swap": "nx",
    }[strategy]
    after = "CASE WHEN lag(j) OVER (PARTITION BY sample_id, level, f ORDER BY pos) IS NOT NULL THEN pv ELSE c END" if strategy == "swap" else "c"
    return head + f"""
p AS (SELECT r.sample_id, r.level, r.f, r.seed, r.j, e.pos FROM r JOIN e USING ({using}, rank)),
q AS (SELECT b.level, x.*, p.j, p.seed FROM b JOIN x USING (sample_id, f) LEFT JOIN p ON p.sample_id = b.sample_id AND p.level = b.level AND p.f = b.f AND p.pos = x.pos WHERE b.k > 0),
o AS (SELECT sample_id, level, f, pos, CASE WHEN j IS NOT NULL THEN {out} ELSE {after} END AS o FROM q),
z AS (SELECT sample_id, level, f, string_agg(o, '' ORDER BY pos) AS o FROM o GROUP BY ALL)"""


def _sql_map(table: dict[str, str]) -> str:
    return "translate(c, '" + "".join(table) + "', '" + "".join(table.values()) + "')"


def oracle(strategy: str, source: str = SINGLE_SQL, base_seed: int = BASE_SEED, cte: str = "", unit: str = "letter") -> str:
    """sample_id, level, change_count and the MD5 of the perturbed texts, one after another with chr(1) between them (null where nothing changes)."""
    return f"""WITH {cte}{sql_steps(strategy, source, base_seed, unit)}
SELECT sample_id, level, sum(k)::BIGINT AS change_count, CASE WHEN sum(k) > 0 THEN md5(string_agg(coalesce(o, t), chr(1) ORDER BY f)) END AS corrupted_md5 FROM b LEFT JOIN z USING (sample_id, level, f) GROUP BY ALL"""
