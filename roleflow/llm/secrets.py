"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleflow.session import Scratch

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A text without any of these, in lower case, holds no assignment.
NAMES = ("passw", "secret", "token", "api")
#: A run of the class that is long enough is found from its first character on, so the length can stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASS = "[A-Za-z0-9+/_=-]"
SPAN = "struct<s:int,kind:int,e:int>"
#: Matches that one list is made of before the lists are put together, and characters that a piece of a text has.
GROUP, PIECE = 256, 4096


@dataclass(frozen=True)
class Settings:
    """``least``: length of a run that is judged; ``threshold``: nats a pair of characters by which a secret is likelier random than ordinary, at
    least; ``alarms``: share of ordinary long runs that may pass for random, ``missed``: of random ones that may not be found; ``enough``: kept-out long runs of either kind without which ``unsure`` is the threshold;
    ``made``: random strings that are made as samples; ``words``: words of a made identifier; ``pairs``: pairs without which a run is not judged."""

    least: int = 20
    backing: float = 20.0
    own: float = 0.5
    threshold: float = 0.5
    unsure: float = 0.6
    enough: int = 200
    alarms: float = 0.001
    missed: float = 0.02
    made: int = 8192
    words: int = 4
    pairs: int = 8
    mark: str = "<SECRET>"

    @property
    def run(self) -> str:
        return f"(?<!{CLASS}){CLASS}{{{self.least},}}"


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of character pairs, and the threshold of their mean over a run; of the runs that calibrated it, the share of random
    ones it finds and of ordinary ones it takes for random (null without such runs)."""

    ratios: list[float]
    threshold: float
    found: float | None = None
    alarms: float | None = None


def _fold(size: str, start: str, step: str, item: str, finish: str = "flatten(o.out)") -> str:
    """SQL of a fold over i from 0 to ``size`` - 1 that makes a list of ``item``: ``step`` gives state and list from ``a.st, a.out, i``.

    The list grows in groups, so that a long one isn't copied for each of its items.
    """
    empty = f"cast(array() as array<{item}>)"
    return (
        f"aggregate(if({size} > 0, sequence(0, cast(({size} - 1) div {GROUP} as int)), cast(array() as array<int>)), "
        f"named_struct('st', {start}, 'out', cast(array() as array<array<{item}>>)), "
        f"(o, g) -> aggregate(sequence(g * {GROUP}, least(g * {GROUP} + {GROUP - 1}, {size} - 1)), named_struct('st', o.st, 'out', {empty}), "
        f"(a, i) -> {step}, a -> named_struct('st', a.st, 'out', concat(o.out, array(a.out)))), o -> {finish})"
    )


def _spans(matches: str, gaps: str, kind: int, keep: str) -> str:
    """SQL for the spans of ``matches``, which stand between ``gaps``; ``keep`` is a condition on match number i."""
    start = f"a.st + length({gaps}[i])"
    end = f"{start} + length({matches}[i])"
    step = f"named_struct('st', {end}, 'out', if({keep}, concat(a.out, array(named_struct('s', {start}, 'kind', {kind}, 'e', {end}))), a.out))"
    return _fold(f"size({matches})", "0", step, SPAN)


def _all(pattern: str, group: int, sure: Column) -> Column:
    """What the pattern finds; texts that are ``sure`` to hold nothing are not searched."""
    return F.when(sure, F.array().cast("array<string>")).otherwise(F.regexp_extract_all("_t", F.lit(pattern), F.lit(group)))


def _without_names() -> Column:
    low = F.lower("_t")
    out = F.lit(True)
    for name in NAMES:
        out &= ~low.contains(name)
    return out


def base(docs: DataFrame) -> DataFrame:
    """``row`` with ``_assign``, ``_access``, ``_hex``: spans of the fixed patterns in code points, end exclusive.

    A text is searched once for each pattern; where it has matches, the pieces between them give the places.
    """
    # The row travels as one struct, so none of its columns can clash with those made here.
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    sure = (_without_names(), ~F.col("_t").contains("AKIA"), F.lit(False))
    found = found.withColumns({f"_m{k}": _all(p, 0, sure[k]) for k, p in enumerate((ASSIGN, ACCESS, HEX))})
    found = found.withColumns({f"_g{k}": F.when(F.size(f"_m{k}") > 0, F.split("_t", p, -1)) for k, p in enumerate((ASSIGN, ACCESS, HEX))} | {"_v": F.when(F.size("_m0") > 0, F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2)))})
    keep = ("length(_v[i]) >= 6", "true", "true")
    found = found.withColumns({f"_{KINDS[k]}": F.expr(_spans(f"_m{k}", f"_g{k}", k, keep[k])) for k in range(3)})
    return found.drop(*[f"_{x}{k}" for x in "mg" for k in range(3)], "_v")


def samples(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``label, run, count``: the labelled samples, each different run of characters once.

    Label 1 are the secrets that the fixed patterns find in all documents, label 2 digests in hexadecimal, base64, and letters and digits of one case, as many as
    the settings say; label 0 the other runs of four characters or more of all documents, for each of their occurrences. Long ones with a letter and a digit may be
    secrets: they are split at their signs, and what is long then is in no sample. Label 3 are identifiers made of :func:`identifiers`.
    """
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    fixed = f"{ASSIGN}|{ACCESS}|{HEX}"
    values = F.concat(_all(ASSIGN, 2, _without_names()), F.regexp_extract_all("_t", F.lit(f"{ACCESS}|{HEX}"), F.lit(0)))
    plain = F.regexp_extract_all(F.regexp_replace("_t", fixed, " "), F.lit(f"{CLASS}{{4,}}"), F.lit(0))
    both = F.array(F.struct(F.lit(1).alias("label"), F.transform(F.filter(values, lambda x: F.length(x) >= 16), lambda x: F.rtrim(x, F.lit("="))).alias("runs")), F.struct(F.lit(0).alias("label"), plain.alias("runs")))
    seen = rows.select(F.explode(both).alias("x")).select("x.label", F.explode("x.runs").alias("run")).groupBy("label", "run").count()
    mixed = (F.col("label") == 0) & (F.length("run") >= settings.least) & F.col("run").rlike("[0-9]") & F.col("run").rlike("[A-Za-z]")
    parts = F.when(mixed, F.split("run", "[-_/=+]+")).otherwise(F.array("run"))
    seen = seen.select("label", "count", F.explode(parts).alias("run"), mixed.alias("mixed")).where(f"not mixed or length(run) between 2 and {settings.least - 1}")
    digest = F.sha2(F.col("id").cast("string"), 512)
    narrow = F.conv(F.substring(digest, 1, 15), 16, 36)
    wide = F.concat(narrow, F.conv(F.substring(digest, 16, 15), 16, 36))
    forms = F.array(F.rtrim(F.base64(F.unhex(digest)), F.lit("=")), F.substring(digest, 1, 64), F.upper(wide), F.lower(wide), F.rtrim(F.translate(F.base64(F.unhex(F.sha2(digest, 256))), "+/", "-_"), F.lit("=")))
    made = docs.sparkSession.range(settings.made).select(F.lit(2).alias("label"), F.explode(forms).alias("run"), F.lit(1).cast("long").alias("count"))
    return seen.select("label", "run", "count").unionByName(made).groupBy("label", "run").agg(F.sum("count").alias("count"))


def identifiers(runs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``label`` 3, ``run, count``: identifiers of the shapes that code and logs have, made of the words among the ordinary runs.

    Each different word is in about one identifier of each shape: snake, kebab, camel and upper case, paths, dates, versions, numbered names, settings; rules of one
    sign stand beside them.
    """
    words = runs.where("label = 0").select(F.lower("run").alias("word")).where(F.col("word").rlike("^[a-z]{2,15}$")).distinct()
    n = words.count()
    bucket = F.pmod(F.xxhash64("word"), F.lit(max(1, n // settings.words)))
    sets = words.groupBy(bucket.alias("b")).agg(F.slice(F.array_sort(F.collect_list("word")), 1, 2 * settings.words).alias("w"))
    h = F.pmod(F.xxhash64("b"), F.lit(1 << 40))
    number = lambda low, many, width, shift: F.lpad((low + F.expr(f"pmod(shiftright(xxhash64(b), {shift}), {many})")).cast("string"), width, "0")
    day = F.concat_ws("-", number(1990, 45, 4, 0), number(1, 12, 2, 6), number(1, 28, 2, 11))
    clock = F.concat_ws("-", number(0, 24, 2, 17), number(0, 60, 2, 23), number(0, 60, 2, 29), number(0, 1000, 3, 31))
    first, last = F.element_at("w", 1), F.element_at("w", -1)
    camel = F.array_join(F.transform("w", lambda x: F.initcap(x)), "")
    shapes = F.array(
        F.array_join("w", "_"), F.array_join("w", "-"), F.array_join("w", "/"), F.upper(F.array_join("w", "_")), camel, F.concat(first, F.substring(camel, 2, 200)),
        F.concat(F.lit("/"), F.array_join("w", "/"), number(0, 10, 1, 3)), F.concat(F.array_join("w", "-"), F.lit("-"), day), F.concat(day, F.lit("T"), clock, F.lit("-Z-"), number(0, 100, 2, 9)),
        F.concat(first, F.lit("-"), day, F.lit("-"), last, F.lit("-"), number(0, 100_000, 5, 13)), F.concat(F.array_join("w", "-"), F.lit("-v"), number(0, 40, 1, 5), F.lit("-"), number(0, 30, 1, 8)),
        F.concat(F.array_join("w", "/"), F.lit("/v"), number(0, 40, 1, 5), F.lit("/"), last), F.concat(F.array_join("w", "_"), F.lit("_"), number(0, 1000, 1, 15)), F.concat(F.array_join("w", "-"), F.lit("="), last),
        F.concat(F.array_join("w", "_"), F.lit("_id="), h.cast("string")), F.concat_ws("-", number(0, 1000, 3, 1), number(0, 1000, 3, 4), number(0, 10_000, 4, 7), number(0, 10_000, 4, 10), number(0, 10_000, 4, 14)),
    )
    spread = sets.select(F.explode(shapes).alias("run"))
    rules = runs.sparkSession.range(20, 120).select(F.explode(F.array(*[F.expr(f"repeat('{c}', cast(id as int))") for c in "-=_/+"])).alias("run"))
    return spread.unionByName(rules).groupBy("run").count().select(F.lit(3).alias("label"), "run", "count")


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Markov models of the labelled :func:`samples`, compared: pairs of characters, random over ordinary.

    Found and made samples of either kind weigh the same. A run counts for each of its occurrences; equal runs are one row before their pairs
    are made. The driver gets a count for each label and pair, of the fixed alphabet. The threshold lies in the middle
    between what ``alarms`` of the ordinary and ``missed`` of the random long runs reach that were kept out of a first model (a fifth of all, by hash), made ones
    among them; where these overlap, at what ``alarms`` of the ordinary ones reach.
    """
    with Scratch(docs.sparkSession) as tables:
        seen = tables.put(samples(docs, settings))
        return _fitted(tables.put(seen.unionByName(identifiers(seen, settings))), settings)


def _fitted(runs: DataFrame, settings: Settings) -> Model:
    runs = runs.withColumn("held", F.pmod(F.xxhash64("run"), F.lit(5)) == 0)
    chars = runs.select("label", "held", "count", F.split("run", "").alias("c"))
    pairs = chars.select("label", "held", "count", F.explode(F.expr("arrays_zip(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1))")).alias("p"))
    counts = pairs.groupBy("label", "held", F.col("p.0").alias("a"), F.col("p.1").alias("b")).agg(F.sum("count").alias("n"))
    width, code = len(LETTERS), {c: i for i, c in enumerate(LETTERS)}
    tables = {held: [[[0.0] * width for _ in range(width)] for _ in range(4)] for held in (True, False)}
    for r in counts.where(F.col("a").isin(*LETTERS) & F.col("b").isin(*LETTERS)).toLocalIterator():
        tables[r["held"]][r["label"]][code[r["a"]]][code[r["b"]]] += r["n"]
    part = _ratios(tables[False], settings)
    every = _ratios([_plus(s, t, 1.0) for s, t in zip(*tables.values(), strict=True)], settings)
    random = F.col("label").isin(1, 2).alias("random")
    long = runs.where(F.col("held") & (F.length("run") >= settings.least)).select(random, _mean(F.col("run"), part, settings).alias("nats"))
    kept = long.groupBy("random").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("nats", 1 - settings.alarms, 10_000).alias("top"), F.percentile_approx("nats", settings.missed, 10_000).alias("low"))
    kept = {r["random"]: r for r in kept.collect()}
    sure = all(k in kept and kept[k]["n"] >= settings.enough for k in (True, False))
    threshold = settings.unsure
    if sure:
        top = kept[False]["top"]
        threshold = max(settings.threshold, (top + max(top, kept[True]["low"])) / 2)
    share = {r["random"]: r["share"] for r in long.groupBy("random").agg(F.avg((F.col("nats") >= threshold).cast("double")).alias("share")).collect()}
    return Model(every, threshold, share.get(True), share.get(False))


def _plus(a: list[list[float]], b: list[list[float]], scale: float) -> list[list[float]]:
    return [[x + y * scale for x, y in zip(u, v, strict=True)] for u, v in zip(a, b, strict=True)]


def _ratios(counts: list[list[list[float]]], settings: Settings) -> list[float]:
    """Log-likelihood ratios of pairs from the counts of the labels 0 to 3; of either kind the found ones are scaled to the made ones' weight."""
    mass = [sum(map(sum, t)) for t in counts]
    scaled = lambda found, made: _plus(counts[made], counts[found], mass[made] / mass[found] if mass[found] and mass[made] else 1.0)
    p, r = (_transitions(t, settings) for t in (scaled(0, 3), scaled(1, 2)))
    return [math.log(x) - math.log(y) for xs, ys in zip(r, p, strict=True) for x, y in zip(xs, ys, strict=True)]


def _transitions(counts: list[list[float]], settings: Settings) -> list[list[float]]:
    """Probabilities of the next character: what a character was followed by, and beside it how its class is followed by the next one's class.

    A pair that the samples lack is thus as likely as its classes make it: a small letter after a stroke, a digit after a digit.
    """
    width = len(counts)
    kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in LETTERS]
    moves, single = [[1.0] * 4 for _ in range(4)], [1.0] * width
    for a in range(width):
        for b in range(width):
            moves[kind[a]][kind[b]] += counts[a][b]
            single[b] += counts[a][b]
    inside = [sum(x for x, k in zip(single, kind, strict=True) if k == c) for c in range(4)]
    out = []
    for a, row in enumerate(counts):
        n = sum(row)
        own = settings.own * n / (n + settings.backing)
        to = moves[kind[a]]
        out.append([own * (row[b] / n if n else 0.0) + (1 - own) * to[kind[b]] / sum(to) * single[b] / inside[kind[b]] for b in range(width)])
    return out


def _mean(run: Column, ratios: list[float], settings: Settings) -> Column:
    """The mean of the ratios of a run's pairs; a character outside the alphabet breaks the run, too few pairs say nothing."""
    width = len(LETTERS)
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    codes = F.split(F.lit(",".join(str(LETTERS.find(chr(i))) for i in range(128))), ",").cast("array<int>")
    inside = lambda a, c: (a["last"] >= 0) & (F.get(codes, F.ascii(c)) >= 0)
    return F.aggregate(
        F.split(run, ""),
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda a, c: F.struct(
            F.get(codes, F.ascii(c)).alias("last"),
            F.when(inside(a, c), a["sum"] + F.get(table, a["last"] * width + F.get(codes, F.ascii(c)))).otherwise(a["sum"]).alias("sum"),
            F.when(inside(a, c), a["n"] + 1).otherwise(a["n"]).alias("n"),
        ),
        lambda a: F.when(a["n"] >= settings.pairs, a["sum"] / a["n"]).otherwise(F.lit(-1000.0)),
    )


def find(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``spans``: array of (s, kind, e) by start, then kind; the kinds are numbered as in KINDS.

    Besides the fixed patterns, every run of ``least`` characters or more is a secret if its pairs are in the mean likelier in random
    strings than in ordinary ones by the model's threshold. A run that holds matches of the fixed patterns is judged on
    the rest, and ends where an assignment in it begins. Null text is empty and has no span. No row is shuffled or dropped; the
    work on a text is linear in its length and in its matches.
    """
    found = base(docs).withColumn("_r", F.regexp_extract_all("_t", F.lit(settings.run), F.lit(0)))
    found = found.withColumn("_rg", F.when(F.size("_r") > 0, F.split("_t", settings.run, -1)))
    # A blank stands for what a fixed pattern takes out of a run; no pair goes over it.
    held = f"{ASSIGN[:-2]}{{6,}})|{ACCESS}|{HEX}"
    judged = F.transform("_r", lambda run: _mean(F.regexp_replace(run, held, " "), model.ratios, settings) >= model.threshold)
    found = found.withColumn("_ok", judged).withColumn("_random", F.expr(_spans("_r", "_rg", 3, "_ok[i]")))
    # From the last to the first: a random run ends where the next assignment begins. Then from the first to the last: it is none of its
    # own if it begins inside an assignment.
    found = found.withColumn("_x", F.expr("if(size(_random) > 0, reverse(array_sort(concat(_assign, _random))), _random)"))
    end = "if(_x[i].kind = 0, _x[i].e, least(_x[i].e, a.st))"
    ended = _fold("size(_x)", "2147483647", f"named_struct('st', if(_x[i].kind = 0, _x[i].s, a.st), 'out', concat(a.out, array(named_struct('s', _x[i].s, 'kind', _x[i].kind, 'e', {end}))))", SPAN)
    found = found.withColumn("_x", F.expr(ended)).withColumn("_x", F.reverse("_x"))
    alone = _fold("size(_x)", "0", "named_struct('st', if(_x[i].kind = 0, greatest(a.st, _x[i].e), a.st), 'out', if(_x[i].kind = 3 and _x[i].s >= a.st, concat(a.out, array(_x[i])), a.out))", SPAN)
    own = [F.col("row")[c].alias(c) for c in docs.columns if c != "spans"]
    return found.select(*own, F.array_sort(F.concat("_assign", "_access", "_hex", F.expr(alone))).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _piece(a: str, b: str) -> str:
    """SQL for the characters from ``a`` to before ``b`` of a text that stands in ``_b`` as pieces of PIECE characters."""
    first, last = f"cast({a} div {PIECE} as int)", f"cast(({b} - 1) div {PIECE} as int)"
    within = f"substring(_b[{first}], {a} % {PIECE} + 1, {b} - {a})"
    over = f"concat(substring(_b[{first}], {a} % {PIECE} + 1, {PIECE}), array_join(slice(_b, {first} + 2, {last} - {first} - 1), ''), substring(_b[{last}], 1, ({b} - 1) % {PIECE} + 1))"
    return f"if({a} >= {b}, '', if({first} = {last}, {within}, {over}))"


def redact(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by the mark; a keyword and its sign stay, its value goes.

    Texts without secrets, null included, stay as they are. A text with secrets is cut once into pieces of a fixed length, from which the
    parts between the secrets are taken, so the work is linear in the text and in its secrets.
    """
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    found = find(packed, model, settings).withColumn("_b", F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    # Of an assignment only the value goes.
    value = f"length(regexp_extract({_piece('x.s', 'x.e')}, _assignment, 2))"
    found = found.withColumn("_assignment", F.lit(ASSIGN))
    found = found.withColumn("_v", F.when(F.size("spans") > 0, F.array_sort(F.expr(f"transform(spans, x -> named_struct('s', if(x.kind = 0, x.e - {value}, x.s), 'e', x.e))"))))
    part = f"if(_v[i].s < a.st, cast(array() as array<string>), array({_piece('a.st', '_v[i].s')}, '{settings.mark}'))"
    step = f"named_struct('st', greatest(a.st, _v[i].e), 'out', if(_v[i].e <= a.st, a.out, concat(a.out, {part})))"
    merged = F.expr(_fold("size(_v)", "0", step, "string", f"concat(array_join(flatten(o.out), ''), {_piece('o.st', 'length(text)')})"))
    text = F.when(F.size("spans") > 0, merged).otherwise(F.col("text"))
    return found.select(*[text.alias("text") if c == "text" else F.col("whole")[c].alias(c) for c in docs.columns])
