"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Texts become sequences of canonical tokens: numbers are `<num>`, units `<unit>`, capitalised words `<name>`, all other
words themselves in lower case. Windows of WINDOW canonical tokens of the benchmark items are joined by hash with all
windows of the documents; so are windows in which names are themselves in lower case, which finds copies whose letter case was
changed. For a document and an item, windows at the same shift form an alignment; what its slots hold is
compared: each number, unit or name of the item must stand for one value in the document throughout, or the alignment
does not count. A re-parameterised question so matches like a verbatim one. Tokens match that have one canonical form or are
the same word. A pair is contaminated if consistent
alignments cover at least COVER of the item's windows, or if LONG matching tokens in a row hold a window that was found and
have consistent slots, whatever stands elsewhere in the alignment.

Defined cases: null and empty texts match nothing. Items with fewer than WINDOW tokens are one window of their own
length; items with fewer than SHORT tokens or only of slots cannot be told apart and match nothing. Equal items match
alike. Documents with one id are told apart by their texts, null ids too; rows equal in both count as one. Extra columns,
whatever their names, are ignored by ``find`` and kept by ``drop_contaminated``. Empty tables give empty results.
Whole texts are read; a passage may stand anywhere and any number of times. A copy whose names and letter case were both
changed is found by its other windows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, stage, text_key, without

WINDOW = 8
SHORT = 5
COVER = 0.5
LONG = 20
#: Literal tokens that a window needs.
LITERAL = 3

TOKEN = r"[\p{L}\p{N}]+(?:[.,:'’-][\p{L}\p{N}]+)*|[%€$£°]"
#: Words that count as numbers and as units.
NUMBERS = "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion dozen half"
UNITS = (
    "% € $ £ ° km kilometers kilometres kilometer kilometre m meters metres meter metre cm centimeters centimetres mm miles mile feet foot ft "
    "inches inch yards yard kg kilograms kilogram g grams gram mg lb lbs pounds pound ounces ounce oz tons tonnes l liters litres liter litre ml "
    "gallons gallon seconds second sec minutes minute min hours hour h days day weeks week months month years year mph kmh kph hz khz mhz ghz w kw "
    "kwh v volts amps j joules kj cal kcal degrees degree celsius fahrenheit dollars dollar cents cent euros euro usd eur gbp percent"
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)


def _in(t: Column, words: str) -> Column:
    return t.isin(*words.split())


def _low(t: Column) -> Column:
    """Lower case; the one letter of these texts' scripts that upper case writes as two is two here too."""
    return F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))


def _plain(t: Column) -> Column:
    """The canonical form of a token, names as themselves."""
    low = _low(t)
    return F.when(F.substring(t, 1, 1).between("0", "9") | _in(low, NUMBERS), "<num>").when(_in(low, UNITS), "<unit>").otherwise(low)


def _named(t: Column, plain: Column) -> Column:
    first = F.substring(t, 1, 1)
    return F.when((first != F.lower(first)) & ~plain.startswith("<"), "<name>").otherwise(plain)


def _canonical(t: Column) -> Column:
    return _named(t, _plain(t))


def _hashes(words: Column) -> Column:
    """For each token the hashes (a, b) of its canonical form and of that with names as themselves."""
    both = F.transform(words, lambda t: F.struct(t.alias("t"), _plain(t).alias("p")))
    return F.transform(both, lambda x: F.struct(F.xxhash64(_named(x["t"], x["p"])).alias("a"), F.xxhash64(x["p"]).alias("b")))


def _windows(hashed: str, size: int) -> Column:
    """(size, at, keys) of all windows over a column of _hashes (a column, so that they are computed once). A window has two
    keys if a name is in it, else one."""
    n, none = F.size(hashed), "array<struct<size:int,at:int,a:bigint,b:bigint>>"

    def one(i: Column) -> Column:
        a, b = (F.xxhash64(*[F.get(hashed, i + j)[k] for j in range(size)]) for k in ("a", "b"))
        return F.struct(F.lit(size).alias("size"), i.alias("at"), a.alias("a"), b.alias("b"))

    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), one)).otherwise(F.array().cast(none))


def _keys(w: str) -> Column:
    a, b = F.col(f"{w}.a"), F.col(f"{w}.b")
    return F.explode(F.when(a == b, F.array(a)).otherwise(F.array(a, b)))


def _items(benchmark: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(item, size, i, w, canon, words): a row for each key of each window that has LITERAL literal tokens."""
    base = benchmark.select(F.col(id_col).alias("item"), _words(F.col(text_col)).alias("words"))
    base = base.withColumn("canon", F.transform("words", _canonical)).filter(F.size("canon") >= SHORT).withColumn("h", _hashes(F.col("words")))
    sizes = [(s, F.size("canon") == s) for s in range(SHORT, WINDOW)] + [(WINDOW, F.size("canon") >= WINDOW)]
    parts = [base.filter(fits).select("item", "canon", "words", F.explode(_windows("h", s)).alias("x")) for s, fits in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.select("item", "canon", "words", "x.size", F.col("x.at").alias("i"), _keys("x").alias("w"))
    literal = F.size(F.filter(F.slice("canon", F.col("i") + 1, F.col("size")), lambda t: ~t.startswith("<")))
    return out.filter(literal >= LITERAL)


def _found(docs: DataFrame, benchmark: DataFrame, item_text: str, item_id: str) -> DataFrame:
    """docs(id, th, text) to (id, th, item, coverage, n_tokens, verbatim); th tells texts with one id apart."""
    windows = stage(_items(benchmark, item_text, item_id), "windows")
    totals = windows.groupBy("item").agg(F.countDistinct("i").alias("n_windows"), F.first("words").alias("i_words"), F.first("canon").alias("i_canon"))
    totals = stage(totals, "items")
    sizes = sorted({r["size"] for r in windows.select("size").distinct().collect()} | {WINDOW})

    hashed = docs.select("id", "th", _hashes(_words(F.col("text"))).alias("h"))
    every = F.concat(*[_windows("h", s) for s in sizes]) if len(sizes) > 1 else _windows("h", sizes[0])
    at = hashed.select("id", "th", F.explode(every).alias("x")).select("id", "th", "x.size", F.col("x.at").alias("d"), _keys("x").alias("w"))
    keys = bounded(stage(windows.select("size", "w").distinct(), "keys"), 48)
    hits = stage(at.join(keys, ["size", "w"], "left_semi"), "hits")

    marks = windows.select("item", "size", "i", "w").distinct()
    aligned = (
        hits.join(bounded(marks, 64), ["w", "size"])
        .groupBy("id", "th", "item", "size", (F.col("d") - F.col("i")).alias("shift"))
        .agg(F.collect_set("i").alias("seen"))
    )
    aligned = stage(aligned, "aligned")

    hit = stage(aligned.select(F.col("id").alias("hit"), F.col("th").alias("hit_th")).distinct(), "hit")
    again = docs.join(bounded(hit, 64), F.col("id").eqNullSafe(F.col("hit")) & (F.col("th") == F.col("hit_th")), "left_semi").dropDuplicates(["id", "th"])
    again = again.select("id", "th", _words(F.col("text")).alias("d_words")).withColumn("d_canon", F.transform("d_words", _canonical))
    lo, hi = F.array_min("seen"), F.array_max("seen") + F.col("size") - 1
    joined = aligned.select(F.col("id").alias("a_id"), F.col("th").alias("a_th"), "item", "size", "shift", "seen").join(again, F.col("a_id").eqNullSafe(F.col("id")) & (F.col("a_th") == F.col("th")))
    letters, slots = totals.agg(F.coalesce(F.sum(F.length(F.array_join("i_words", " "))), F.lit(0)), F.coalesce(F.sum(F.size("i_words")), F.lit(0))).first()
    both = joined.join(bounded(totals, 1, 2 * int(letters) + 32 * int(slots)), "item")
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("i_words") - 1),
        lambda p: F.struct(
            p.alias("p"), _low(F.get("i_words", p)).alias("a"), _low(F.get("d_words", p + F.col("shift"))).alias("b"),
            F.get("i_canon", p).alias("x"), F.get("d_canon", p + F.col("shift")).alias("y"),
        ),
    )
    both = both.withColumn("pairs", pairs).withColumns({"lo": lo, "hi": hi})
    same = lambda s: s["x"].eqNullSafe(s["y"]) | s["a"].eqNullSafe(s["b"])
    # runs: stretches of matching tokens between two breaks that hold a window that was found
    unlike = F.transform(F.filter("pairs", lambda s: ~same(s)), lambda s: s["p"])
    both = both.withColumn("breaks", F.concat(F.array(F.lit(-1)), unlike, F.array(F.size("i_words"))))
    runs = F.transform(F.sequence(F.lit(1), F.size("breaks") - 1), lambda k: F.struct((F.get("breaks", k - 1) + 1).alias("lo"), (F.get("breaks", k) - 1).alias("hi")))
    both = both.withColumn("runs", F.filter(runs, lambda r: F.exists("seen", lambda i: (i >= r["lo"]) & (i + F.col("size") - 1 <= r["hi"]))))

    def checked(lo: Column, hi: Column) -> Column:
        """(n_tokens, consistent, verbatim) of the slots from lo to hi."""
        slots = F.filter("pairs", lambda s: (s["p"] >= lo) & (s["p"] <= hi) & same(s) & s["x"].startswith("<"))
        values = lambda *names: F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(s["x"], *[s[k] for k in names]))))
        return F.struct((hi - lo + 1).alias("n_tokens"), (values("a") == values("a", "b")).alias("consistent"), (~F.exists(slots, lambda s: s["a"] != s["b"])).alias("verbatim"))

    both = both.withColumn("whole", checked(F.col("lo"), F.col("hi"))).withColumn("runs", F.filter(F.transform("runs", lambda r: checked(r["lo"], r["hi"])), lambda r: r["consistent"]))
    # an alignment that is inconsistent as a whole counts by its long consistent runs only, which cover no windows
    long_runs = F.filter("runs", lambda r: r["n_tokens"] >= LONG)
    consistent = F.col("whole.consistent")
    per = both.filter(consistent | (F.size(long_runs) > 0)).select(
        "id", "th", "item", "n_windows",
        F.when(consistent, F.col("whole.verbatim")).otherwise(~F.exists(long_runs, lambda r: ~r["verbatim"])).alias("verbatim"),
        F.array_max(F.transform("runs", lambda r: r["n_tokens"])).alias("run"),
        F.explode_outer(F.when(consistent, F.col("seen"))).alias("i"),
    )
    return (
        per.groupBy("id", "th", "item")
        .agg(
            (F.countDistinct("i") / F.max("n_windows")).alias("coverage"),
            F.max("run").cast("long").alias("n_tokens"),
            F.min("verbatim").alias("verbatim"),
        )
        .filter((F.col("coverage") >= COVER) | (F.col("n_tokens") >= LONG))
    )


def _keyed(documents: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return documents.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))


def find(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Contaminated pairs: id, item id, coverage (0 to 1), n_tokens (longest run), verbatim (all slots as in the item)."""
    found = _found(_keyed(documents, text_col, id_col), benchmark, item_text, item_id)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "coverage", "n_tokens", "verbatim")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of documents whose text holds no benchmark item, with all columns."""
    return without(documents, _found(_keyed(documents, text_col, id_col), benchmark, item_text, item_id), id_col, text_col)
