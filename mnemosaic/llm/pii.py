"""Personal data: base patterns, and more spans from boosted trees over proposed candidates. SQL functions alone.

Base spans are the leftmost non-overlapping matches of a pattern for each kind, filtered (IP parts, Luhn, digit
counts); they always stay. High-recall generators then propose further candidates that may overlap: phone numbers
without a plus, e-mail addresses in disguise, spaced IPs, dotted card numbers, each from every place where one may start. Features are patterns over the
candidate with its context; boosted trees of depth two, fitted on a small generated table, give integer scores; a threshold for
each kind is calibrated on generated rows of its own. A candidate over it is added unless it overlaps a base span or a
better candidate (higher score, then earlier start, then longer, then the kind listed first).

Positions are code points. Lookbehinds and possessive quantifiers keep the base patterns' matches and make them linear in
the text, so a very long text is scanned whole. Edge cases: null texts count as empty and have no span; repeated rows and null
doc_ids stay. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import needed

KINDS = ("email", "ip", "card", "phone")
BASE = {
    # A run of the local part's characters is tried once, at its start or where the match before ended.
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SEP, _AT, _DOT = r"[\x20.-]", r"(?:\x20?[\[({]at[\])}]\x20?|\x20at\x20)", r"(?:\x20?[\[({]dot[\])}]\x20?|\x20dot\x20|\x20?\.\x20?)"
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]{1,63}"
#: Generators. All forms of a group are tried from every place where one may start, so nothing before a candidate swallows it, and one place may
#: give several ends; they end where their run of digits or letters does. A group's texts are marked in one pass.
NUMBERS = (
    ("ip", r"[0-9]{1,3}(?:\x20\.\x20?|\.\x20)[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){2}(?![0-9])"),
    ("card", r"[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{4}(?![0-9])"),
    ("phone", rf"\(?[0-9]{{2,4}}\)?{_SEP}[0-9]{{3,4}}{_SEP}[0-9]{{2,4}}(?![0-9])"),
    ("phone", rf"\(?[0-9]{{2,4}}\)?{_SEP}[0-9]{{3,4}}(?:{_SEP}[0-9]{{2,4}}){{2}}(?![0-9])"),
    ("phone", r"[0-9]{9,15}(?![0-9])"),
)
NUMBER_START = r"(?<![0-9])(?=\(?[0-9])(?=\(?[0-9]{1,4}\)?[\x20./-]|[0-9]{9})"
#: The local part stands before the place of the "at", and a domain of two or more labels after it.
DISGUISED = (("email", rf"{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{1,4}}(?![A-Za-z0-9-])"), ("email", rf"{_AT}{_LABEL}{_DOT}{_LABEL}(?![A-Za-z0-9-])"))
DISGUISED_START = rf"(?i)(?=\x20?[\[({{]at[\])}}]|\x20at\x20)(?<=((?<!{_LOCAL}){_LOCAL}{{1,64}}))"
#: What a text must hold for a kind's patterns to be run.
HINT = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]"}
DISGUISED_HINT = r"(?i)[\[({\x20]at[\])}\x20]"
#: Forms, where one may start, whether a part before the place belongs to them, and what a text must hold.
GROUPS = ((NUMBERS, NUMBER_START, 0, r"[0-9]{3}|[0-9]\x20?\."), (DISGUISED, DISGUISED_START, 1, DISGUISED_HINT))
#: No candidate is longer, and so many may start at one place: what bounds the search for overlaps.
LONGEST, AT_ONCE = 64 + 6 + 63 * 5 + 4 * 7, len(NUMBERS) + len(DISGUISED)
#: Features: patterns over "context<candidate>context", the same to Java and to Python.
FEATURES = (
    r"(?i)(?:phone|tel|call|mobile|fax|dial|whatsapp)[^<]*<", r"(?i)(?:mail|contact|write|reach)[^<]*<", r"(?i)(?:card|visa|credit|pay)[^<]*<",
    r"(?i)(?:host|server|addr|ip|ping)[^<]*<", r"(?i)(?:order|invoice|version|isbn|part|item|page|ref|no\.|#)[^<]*<", r"<(?:19|20)[0-9]{2}[-./ ]",
    r"[-./ ](?:19|20)[0-9]{2}>", r"[0-9A-Za-z.,%/-]<", r">[0-9A-Za-z%/-]", r"<\(", r"(?i)[\[({]at[\])}]", r"(?i)[\[({]dot[\])}]", r"<[^>]*-[^>]*-",
    r"<[^>]* [^>]* ", r"<[^>]*\.[^>]*\.", r"<(?:[^0-9>]*[0-9]){10,15}[^0-9>]*>", r"<(?:[^0-9>]*[0-9]){16}[^0-9>]*>", r"[$€]\x20?<",
    r"(?i)<[^>]*(?:com|org|net|edu|io)>", r"<[0-9]{3}[^0-9][0-9]{3}[^0-9][0-9]{4}>",
    r"<[0-9]+>", r"(?i)<[^>]*\x20at\x20", r"(?i)<[^>]*\x20dot\x20", r"<[^>]*[^0-9][0-9]{1,3}>",
    r"<\(?(?:[0-9]+[^0-9>]+){3}[0-9]+>",
)
CONTEXT, ROUND = 24, 1000
#: Code points of a part of a text; a candidate is shorter.
PART = 1024


def generated(seed: int, n: int = 600) -> list[tuple[str, str, int]]:
    """(kind, context<candidate>context, 1 for personal data)."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "in", "ed", "or")) for _ in range(r.randint(1, 4)))
    rows = []
    for _ in range(n):
        kind, y = r.choice(KINDS), r.random() < 0.5
        sep = r.choice("-. ")
        if kind == "email":
            span = f"{word()}{r.choice(' .')}".strip() + r.choice(("(at)", " [at] ", " (at) ")) + word() + (r.choice((".", " (dot) ", "[dot]")) + r.choice(("com", "org", "net", "edu", "io")) if y else r.choice((".", " .")) + word())
            before = r.choice(("mail ", "contact: ", "write to ", f"{word()} ", ""))
        elif kind == "ip":
            span = " . ".join(str(r.randint(0, 255) if y else r.randint(200, 999)) for _ in range(4))
            before = r.choice(("server ", "host ", "ip: ", "addr ")) if y else r.choice(("page ", "item ", f"{word()} ", "$ "))
        elif kind == "card":
            span = r.choice("./").join(d(4) for _ in range(4))
            before = r.choice(("card ", "visa ", "credit: ", "pay with ")) if y else r.choice(("part ", "order ", "ref ", f"{word()} "))
        elif y:
            span = r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"0{d(2)} {d(4)} {d(4)}"))
            before = r.choice(("phone ", "call me: ", "tel. ", "mobile ", "fax ", "contact ", f"{word()} ", ""))
        else:
            span = r.choice((f"20{d(2)}-0{d(1)}{d(2)}-{d(2)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(3)} {d(3)} {d(3)}", f"19{d(2)} {d(3)} {d(2)}", f"{d(2)} {d(3)}-20{d(2)}", f"{d(4)}-{d(4)}-{d(3)}"))
            before = r.choice(("order ", "invoice ", "isbn ", "version ", "page ", f"{word()} ", "$", "a-"))
        after = r.choice(("", ".", f" {word()}", ", ")) if y or r.random() < 0.7 else r.choice(("5", "%", "-x", "/3"))
        rows.append((kind, f"{before}<{span}>{after}", int(y)))
    return rows + _more(random.Random(seed + 100), n // 2)


def _more(r: random.Random, n: int) -> list[tuple[str, str, int]]:
    """Rows of the forms that STARTS adds: words for at and dot, bare digits, and numbers with a neighbour taken in or cut off."""
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "in", "ed", "or")) for _ in range(r.randint(1, 4)))
    calls, others = ("phone ", "call me: ", "tel ", "mobile ", "fax ", "call "), ("order ", "invoice ", "isbn ", "version ", "item ", "$", "", f"{word()} ")
    rows = []
    for _ in range(n):
        form, y = r.randrange(3), r.random() < 0.5
        after = r.choice(("", ".", f" {word()}", ", "))
        if form == 0:
            end = r.choice(("com", "org", "net", "edu", "io"))
            if y:
                span, before = f"{word()} at {word()} dot {end}", r.choice(("mail ", "contact ", "write to ", f"{word()} ", ""))
            else:
                span, before = r.choice((f"{word()} at {word()} dot {word()}", f"{word()} at {word()}.{word()}", f"{word()} at {word()}.{end}")), r.choice((f"{word()} ", "", "page ", "item "))
            if not y and span.endswith(f".{end}") and r.random() < 0.5:
                before, y = r.choice(("mail ", "contact: ", "write to ")), True
            rows.append(("email", f"{before}<{span}>{after}", int(y)))
        elif form == 1:
            rows.append(("phone", f"{r.choice(calls if y else others)}<{d(10) if y else d(r.randint(9, 15))}>{after}", int(y)))
        else:
            sep = r.choice("-. ")
            number = f"{d(3)}{sep}{d(3)}{sep}{d(4)}"
            before = r.choice((*calls, f"{word()} ", ""))
            if y:
                rows.append(("phone", f"{before}{r.choice((d(2), '20' + d(2), d(2) + ' 20' + d(2)))} <{number}>{r.choice((after, ' ' + d(2)))}", 1))
            else:
                cut = f"<{d(2)} 20{d(2)} {number[:7]}>{number[7:11]}"
                rows.append(("phone", before + r.choice((cut, f"<20{d(2)} {number}>{after}", f"<{d(2)} {number}>{after}", f"<{number} {d(2)}>{after}")), 0))
    return rows


@functools.cache
def boosted(rounds: int = 40, rate: float = 0.3) -> tuple[tuple[tuple[int, int, int, tuple[int, int, int, int]], ...], dict[str, int]]:
    """Trees (feature, feature if it is absent, if present, the four leaves as integers) and each kind's threshold."""
    compiled = [re.compile(f) for f in FEATURES]

    def matrix(rows: list) -> list[list[bool]]:
        return [[bool(c.search(ctx)) for c in compiled] + [kind == k for k in KINDS] for kind, ctx, _ in rows]

    rows, held = generated(1), generated(2)
    x, y = matrix(rows), [r[2] for r in rows]
    score, trees, width = [0.0] * len(rows), [], len(FEATURES) + len(KINDS)

    def leaf(part: list[int], grad: list[float], hess: list[float]) -> tuple[float, float]:
        g, h = sum(grad[i] for i in part), sum(hess[i] for i in part) + 1.0
        return g / h, g * g / h

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad, hess = [a - b for a, b in zip(y, p)], [q * (1 - q) for q in p]

        def split(part: list[int], grad: list[float] = grad, hess: list[float] = hess) -> tuple[float, int]:
            return max((leaf([i for i in part if x[i][f]], grad, hess)[1] + leaf([i for i in part if not x[i][f]], grad, hess)[1], -f) for f in range(width))

        everything = range(len(rows))
        f = -split(everything)[1]
        sides = [[i for i in everything if x[i][f] == bool(s)] for s in (0, 1)]
        subs = [-split(side)[1] for side in sides]
        leaves = []
        for side, g in zip(sides, subs):
            for s in (0, 1):
                part = [i for i in side if x[i][g] == bool(s)]
                v = round(rate * leaf(part, grad, hess)[0] * ROUND)
                leaves.append(v)
                for i in part:
                    score[i] += v / ROUND
        trees.append((f, subs[0], subs[1], tuple(leaves)))
    hx = matrix(held)
    total = [sum(t[3][2 * row[t[0]] + row[t[2] if row[t[0]] else t[1]]] for t in trees) for row in hx]
    limits = {}
    for k in KINDS:  # the lowest threshold with 98 % of what is over it right, and never below even odds
        mine = sorted(((s, r[2]) for s, r in zip(total, held) if r[0] == k), reverse=True)
        good, limit = 0, max(0, mine[0][0])
        for n, (s, right) in enumerate(mine, 1):
            good += right
            if good >= 0.98 * n:
                limit = s
        limits[k] = max(limit, ROUND // 2)
    return tuple(trees), limits


TILE = 64
#: Control characters that no pattern takes part in: marks, and what stands for them where a text has them.
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
SPAN = "array<struct<kind:string,s:int,e:int,m:string>>"


def _none(kind: str = SPAN) -> Column:
    return F.array().cast(kind)


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body of a value that is worked out once: a column that a function over arrays refers to is else worked out for each element."""
    return F.transform(F.array(value), body)[0]


def _tiles(values: Column, size: int = TILE) -> Column:
    """values (a bound variable) in slices of `size`, in order."""
    n = F.ceil(F.size(values) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * size + 1, size))).otherwise(F.array(values))


def _scan(values: Column, op, zero: Column, depth: int = 3) -> Column:  # noqa: ANN001
    """What op, whose neutral element is zero, gives over the integers before each place. Tiles are summed up, so the cost is in proportion to the length."""

    def plain(part: Column) -> Column:
        add = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, F.struct(zero.alias("at"), _none("array<int>").alias("out")), add)["out"]

    def tiled(tiles: Column) -> Column:
        before = _scan(F.transform(tiles, lambda t: F.aggregate(t, zero, op)), op, zero, depth - 1)
        pairs = F.zip_with(tiles, before, lambda t, b: F.struct(t.alias("t"), b.alias("b")))
        return F.flatten(F.transform(pairs, lambda p: F.transform(plain(p["t"]), lambda x: op(p["b"], x))))

    if depth == 1:
        return plain(values)
    return _let(values, lambda v: F.when(F.size(v) <= TILE, plain(v)).otherwise(_let(_tiles(v), tiled)))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _marked(text: Column, pattern: str, marks: str, hint: str) -> Column:
    """The text with marks put in where the pattern matches, cut at OPEN: the first piece has no match."""
    return F.when(text.rlike(hint), F.split(F.regexp_replace(text, F.lit(pattern), F.lit(marks)), OPEN, -1)).otherwise(F.array(text))


def _places(pieces: Column, parts: int, inside: bool) -> Column:
    """For each piece but the first, its place in the text and its parts, which CLOSE ends. inside: whether the text itself has the (one) part."""
    rows = lambda p: F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.split(x, CLOSE, -1))
    own = lambda r: (F.length(F.element_at(r, 1)) if inside else F.lit(0)) + F.length(F.element_at(r, parts + 1))

    def placed(r: Column, first: Column) -> Column:
        return F.zip_with(r, _scan(F.transform(r, own), _add, F.lit(0)), lambda x, s: F.struct((s + first).alias("s"), x.alias("r")))

    return _let(pieces, lambda p: _let(F.length(F.element_at(p, 1)), lambda first: _let(rows(p), lambda r: placed(r, first))))


def _span(kind: str, s: Column, m: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), s.cast("int").alias("s"), (s + F.length(m)).cast("int").alias("e"), m.alias("m"))


def _spans(text: Column, pattern: str, kind: str, hint: str) -> Column:
    """Leftmost non-overlapping matches with their places: an array of (kind, s, e, m)."""
    made = lambda p: F.transform(_places(p, 1, True), lambda x: _span(kind, x["s"], F.element_at(x["r"], 1)))
    return _let(_marked(text, pattern, f"{OPEN}$0{CLOSE}", hint), lambda p: F.when(F.size(p) > 1, made(p)).otherwise(_none()))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    values = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
    "card": lambda m: F.length(_digits(m)).between(13, 19) & _luhn(m),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _score(features: Column, kind: Column) -> Column:
    """The trees' sum for a candidate with these features (an array of booleans), less its kind's threshold."""
    trees, limits = boosted()

    def has(f: int) -> Column:
        return features[f] if f < len(FEATURES) else kind == KINDS[f - len(FEATURES)]

    merged: dict[tuple, list[int]] = {}
    for f, g, h, leaves in trees:  # trees of one shape are summed
        merged[f, g, h] = [a + b for a, b in zip(merged.get((f, g, h), [0] * 4), leaves)]
    total = F.lit(0)
    for (f, g, h), v in sorted(merged.items()):
        total = total + F.when(has(f), F.when(has(h), v[3]).otherwise(v[2])).otherwise(F.when(has(g), v[1]).otherwise(v[0]))
    limit = F.lit(limits[KINDS[-1]])
    for k in KINDS[:-1]:
        limit = F.when(kind == k, limits[k]).otherwise(limit)
    return total - limit


def _overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def _free(found: Column, base: Column) -> Column:
    """Candidates that overlap no base span: one sweep over both in order, for the last end so far and the next start."""
    far = F.lit(2**31 - 1)
    mark = lambda x, c: F.struct(x["s"].alias("s"), F.lit(c).alias("c"), x["e"].alias("e"), x["kind"].alias("kind"), x["m"].alias("m"))

    def swept(both: Column) -> Column:
        ends = _scan(F.transform(both, lambda x: F.when(x["c"] == 0, x["e"]).otherwise(-1)), lambda a, b: F.greatest(a, b), F.lit(-1))
        starts = F.reverse(_scan(F.reverse(F.transform(both, lambda x: F.when(x["c"] == 0, x["s"]).otherwise(far))), lambda a, b: F.least(a, b), far))
        rows = F.zip_with(F.zip_with(both, ends, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), starts, lambda p, s: F.struct(p["x"].alias("x"), p["e"].alias("e"), s.alias("s")))
        kept = F.filter(rows, lambda r: (r["x"]["c"] == 1) & (r["e"] <= r["x"]["s"]) & (r["s"] >= r["x"]["e"]))
        return F.transform(kept, lambda r: F.struct(r["x"]["kind"].alias("kind"), r["x"]["s"].alias("s"), r["x"]["e"].alias("e"), r["x"]["m"].alias("m")))

    both = F.array_sort(F.concat(F.transform(base, lambda x: mark(x, 0)), F.transform(found, lambda x: mark(x, 1))))
    return F.when((F.size(found) > 0) & (F.size(base) > 0), _let(both, swept)).otherwise(found)


def _best(found: Column) -> Column:
    """Candidates (in the order of their starts) that overlap no better one. Those of a tile are compared with its neighbourhood alone, which LONGEST and AT_ONCE bound."""
    order = F.array(*map(F.lit, KINDS))
    key = lambda x: F.struct(-x["score"], x["s"], -x["e"], F.array_position(order, x["kind"]))
    among = lambda part, others: F.filter(part, lambda c: ~F.exists(others, lambda o: _overlap(o, c) & (key(o) < key(c))))
    reach = -(-LONGEST * AT_ONCE // TILE)  # in tiles

    def tiled(tiles: Column) -> Column:
        bounds = F.transform(tiles, lambda t: F.struct(F.element_at(t, 1)["s"].alias("low"), F.array_max(F.transform(t, lambda c: c["e"])).alias("high")))

        def of(bounds: Column) -> Column:
            def one(tile: Column, i: Column) -> Column:
                first = F.greatest(i - reach, F.lit(0))
                own = bounds[i]
                # Tiles before that reach into this one, and tiles after that begin within it.
                near = lambda k: (k == i) | ((bounds[k]["high"] > own["low"]) & (bounds[k]["low"] < own["high"]))
                places = F.filter(F.sequence(first, F.least(i + reach, F.size(bounds) - 1)), near)
                others = F.filter(F.flatten(F.transform(places, lambda k: tiles[k])), lambda o: (o["e"] > own["low"]) & (o["s"] < own["high"]))
                return _let(others, lambda o: among(tile, o))

            return F.flatten(F.transform(tiles, one))

        return _let(bounds, of)

    return _let(found, lambda f: F.when(F.size(f) <= TILE, among(f, f)).otherwise(_let(_tiles(f), tiled)))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (all) and n_added. See the module for edge cases."""
    rows = needed(docs, doc_id=(id_col, "long"), text=(text_col, "string")).select("doc_id", F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE, OTHER * 2).alias("text"))
    text = F.col("text")
    base = rows
    for k in KINDS:
        base = base.withColumn(k, F.filter(_spans(text, BASE[k], k, HINT[k]), _keeps(VALID[k])))
    base = base.withColumn("base", F.concat(*KINDS))
    lists = []
    for n, (forms, start, shared, hint) in enumerate(GROUPS):
        marks = OPEN + "".join(f"${i}{CLOSE}" for i in range(1, len(forms) + shared + 1))
        pieces = _marked(text, start + "".join(f"(?:(?=({form}))|)" for _, form in forms), marks, hint)
        base = base.withColumn(f"pieces{n}", pieces)
        base = base.withColumn(f"at{n}", F.when(F.size(f"pieces{n}") > 1, _places(F.col(f"pieces{n}"), len(forms) + shared, False)))
        for i, (kind, _) in enumerate(forms, 1 + shared):
            lists.append(F.transform(F.filter(f"at{n}", _has(i)), _candidate(kind, i, bool(shared))))
    place = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["m"].alias("m"))
    back = lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))
    proposed = F.concat(*(F.coalesce(x, _none()) for x in lists))
    # In order, equal ones are neighbours.
    once = lambda rows: F.filter(rows, lambda x, i: (i == 0) | (rows[F.greatest(i - 1, F.lit(0))] != x))
    sorted_ = lambda rows: F.transform(_let(F.array_sort(F.transform(rows, place)), once), back)
    proposed = _let(proposed, lambda rows: F.when(F.size(rows) > 0, sorted_(rows)).otherwise(_none()))
    base = base.withColumn("found", proposed).withColumn("found", _free(F.col("found"), F.col("base")))

    # A candidate's surroundings come from the parts of the text beside it, so a long text isn't read through for each.
    cut_up = F.when(F.size("found") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)))

    def seen(c: Column, parts: Column) -> Column:
        k = F.floor(c["s"] / PART).cast("int")
        before = F.greatest(k - 1, F.lit(0))
        left = F.greatest(c["s"] - CONTEXT, F.lit(0))

        def cut(window: Column) -> Column:
            skip = before * PART
            ctx = F.concat(F.translate(F.substring(window, left - skip + 1, c["s"] - left), "<>", "  "), F.lit("<"), c["m"], F.lit(">"), F.translate(F.substring(window, c["e"] - skip + 1, F.lit(4)), "<>", "  "))
            return F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), ctx.alias("ctx"))

        return _let(F.array_join(F.slice(parts, before + 1, k - before + 2), ""), cut)

    def featured(c: Column) -> Column:
        return F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), F.array(*(c["ctx"].rlike(f) for f in FEATURES)).alias("f"))

    def judged(c: Column) -> Column:
        return F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), _score(c["f"], c["kind"]).alias("score"))

    base = base.withColumn("found", F.filter(F.transform(F.transform(_let(cut_up, lambda parts: F.transform("found", lambda c: seen(c, parts))), featured), judged), lambda c: c["score"] >= 0))
    base = base.withColumn("added", _best(F.col("found")))

    def merged(k: str) -> Column:
        places = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))
        return F.array_sort(F.concat(F.transform(k, places), F.transform(F.filter("added", lambda x: x["kind"] == k), places)))

    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return base.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.concat(*map(merged, KINDS))).alias("spans"), F.size("added").alias("n_added"))


def _has(i: int):  # noqa: ANN202
    return lambda x: F.length(F.element_at(x["r"], i)) > 0


def _candidate(kind: str, i: int, shared: bool):  # noqa: ANN202
    """shared: the first part, which stands before the place, belongs to the candidate."""

    def made(x: Column) -> Column:
        m, before = F.element_at(x["r"], i), F.element_at(x["r"], 1)
        return _span(kind, x["s"] - F.length(before), F.concat(before, m)) if shared else _span(kind, x["s"], m)

    return made


def _keeps(valid):  # noqa: ANN001, ANN202
    return lambda x: valid(x["m"])
