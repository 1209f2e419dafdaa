"""Mapping free-entered values to a canonical list, by token-level repair and soft TF-IDF.

Only distinct values are worked on, and of those only distinct tokens meet the vocabulary of the
list, in an equi-join on shared deletions, prefixes and letter skeletons followed by the edit
distance. The corrected tokens of a value are then weighed against every entry that shares one of
them. Sizes: the list and its vocabulary are a reference table and are broadcast up to
:data:`BROADCAST_ENTRIES` entries; beyond that the same joins are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.functions.stated import says_nothing
from cellarium.functions.text import deletions, unaccent

BROADCAST_ENTRIES = 20_000
#: Least soft TF-IDF cosine of a match, and most edits of a word.
ACCEPT, MOST_EDITS = 0.55, 3

# What may stand around a value of this trade without being part of it; an input that a caller may replace or leave out.
AROUND = r"(?i)^\s*\d+\s*-\s+|^\s*class:\s*|\s+type\s*$|\s*\*\s*$|\s*-\s*imported\s*$|\s*\(domestic\)\s*$|\s*/\s*other origin\s*$"


def value_tokens(value: Column, around: str | None = AROUND) -> Column:
    """Lower-case words of a value without decoration, accents, the digit 0 for o, or run-together case."""
    v = F.regexp_replace(F.regexp_replace(value, around, ""), around, "") if around else value
    inverted = v.rlike(r"(^|[^\p{L}])\p{Ll}\p{Lu}")
    v = F.when(inverted, F.regexp_replace(v, r"(?<=\p{Lu})(?=\p{Ll})", " ")).otherwise(F.regexp_replace(v, r"(?<=\p{Ll})(?=\p{Lu})", " "))
    v = F.translate(unaccent(F.lower(v)), "0", "o")
    return F.filter(F.split(v, r"[^\p{L}]+"), lambda w: w != "")


def word_first(word: Column) -> Column:
    """Key by which a short form of a word finds it."""
    return F.array(F.concat(F.lit("!"), F.substring(word, 1, 1)))


def token_keys(word: Column, short: bool = True) -> Column:
    """Keys of which two words within two edits (one, if short) share at least one, and so do a word
    and its beginning, its consonants, its letters in another order, or a short form of it.

    ``short`` is False for the vocabulary, whose words can all have short forms.
    """
    none = F.array().cast("array<string>")
    one = deletions(word, None)
    two = F.when(F.length(word) >= 5, F.flatten(F.transform(one, lambda w: deletions(w, None)))).otherwise(none)
    start = F.when(F.length(word) >= 3, F.array(F.concat(F.lit("^"), F.substring(word, 1, 3)))).otherwise(none)
    bones = F.array(F.concat(F.lit("~"), F.substring(word, 1, 1), F.regexp_replace(F.substring(word, F.lit(2), F.length(word)), "[aeiouy]", "")))
    first = F.when(F.length(word) <= 5, F.array(F.concat(F.lit("!"), F.substring(word, 1, 1)))).otherwise(none)
    letters = F.when(F.length(word) >= 5, F.array(F.concat(F.lit("@"), F.array_join(F.array_sort(F.split(word, "")), "")))).otherwise(none)
    return F.array_distinct(F.concat(first if short else word_first(word), letters, F.array(word), F.when(F.length(word) > 2, one).otherwise(none), two, start, bones))


def token_similarity(token: Column, word: Column, words: Column) -> Column:
    """1 for equal words, less for edits, beginnings and skeletons; null beyond all of them.

    ``words`` is the number of words the vocabulary word stands for: several written as one must be
    typed nearly whole.
    """
    t, w = F.length(token), F.length(word)
    allowed = F.when(w <= 4, 1).when(w <= 7, 2).otherwise(MOST_EDITS)
    d = F.least(F.levenshtein(token, word), F.levenshtein(token, F.concat(word, F.lit("s"))))
    swap = (t == w) & (t >= 3) & (F.array_sort(F.split(token, "")) == F.array_sort(F.split(word, "")))
    edit = F.when((d <= allowed) | swap, 1 - 0.7 * F.when(swap, 1).otherwise(d) / F.greatest(t, w))
    subsequence = F.regexp_like(word, F.concat(F.lit("^"), F.array_join(F.split(token, ""), ".*")))
    part = F.when((words == 1) & (t >= 3) & (t <= 5) & (t < w) & (token != "") & subsequence, F.lit(0.74))
    start = F.levenshtein(token, F.substring(word, F.lit(1), t))
    long = (words == 1) | (t * 10 >= w * 7)
    begin = F.when(long & (t < w) & (t >= 3) & (start == 0), F.lit(0.86)).when(long & (t < w) & (t >= 5) & (start == 1), F.lit(0.78))
    bones = F.when((words == 1) & (t >= 3) & (t < w) & (F.regexp_replace(token, "[aeiouy]", "") == F.regexp_replace(word, "[aeiouy]", "")), F.lit(0.84))
    return F.when(token == word, F.lit(1.0)).when(token == F.concat(word, F.lit("s")), F.lit(0.96)).otherwise(F.greatest(edit, begin, bones, part))


def entry_tokens(entries: DataFrame) -> DataFrame:
    """``list_name, entry_id, token, weight``: words of each entry with their share of its norm."""
    e = entries.select("list_name", "entry_id", F.explode(F.array_distinct(value_tokens(F.col("label")))).alias("token")).distinct()
    df = e.groupBy("list_name", "token").agg(F.count("*").alias("df"))
    n = e.groupBy("list_name").agg(F.countDistinct("entry_id").alias("n"))
    w = e.join(df, ["list_name", "token"]).join(n, "list_name").withColumn("idf", F.log1p(F.col("n") / F.col("df")))
    norm = w.groupBy("list_name", "entry_id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    return w.join(norm, ["list_name", "entry_id"]).select("list_name", "entry_id", "token", "idf", "norm", "n")


def vocabulary(entries: DataFrame) -> DataFrame:
    """``list_name, word, parts``: what a typed token may be repaired to.

    Every word stands for itself. Neighbouring words of a label in any rotation, written as one word,
    stand for all of them.
    """
    labels = entries.select("list_name", value_tokens(F.col("label")).alias("parts"))
    single = labels.select("list_name", F.explode("parts").alias("word")).select("list_name", "word", F.array("word").alias("parts"))
    many = labels.where(F.size("parts") > 1)
    turn = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.concat(F.slice("parts", i + 1, F.size("parts")), F.slice("parts", F.lit(1), i)))
    turned = many.select(F.col("list_name"), F.explode(turn).alias("all_parts"))
    runs = turned.select("list_name", F.explode(F.transform(F.sequence(F.lit(2), F.size("all_parts")), lambda i: F.slice("all_parts", F.lit(1), i))).alias("parts"))
    joined = runs.select("list_name", F.concat_ws("", "parts").alias("word"), "parts")
    return single.unionByName(joined).groupBy("list_name", "word").agg(F.min("parts").alias("parts"))


def repair_tokens(tokens: DataFrame, vocab: DataFrame, small: bool, short_forms: dict[str, str] | None = None) -> DataFrame:
    """``list_name, token, parts, sim``: the vocabulary words a distinct token may stand for.

    A token that is longer than every word by more than the edits allowed can stand for none.
    """
    hint = F.broadcast if small else (lambda x: x)
    plain = tokens.withColumn("typed", F.col("token"))
    if short_forms:
        forms = F.create_map(*[F.lit(x) for kv in short_forms.items() for x in kv])
        plain = tokens.withColumn("typed", F.coalesce(forms[F.col("token")], F.when(F.col("token").endswith("s"), forms[F.expr("left(token, length(token) - 1)")]), F.col("token")))
    longest = vocab.agg(F.coalesce(F.max(F.length("word")), F.lit(0))).scalar()
    plain = plain.where(F.length("typed") <= longest + MOST_EDITS + 1)
    keyed = plain.select("list_name", "token", "typed", F.explode(token_keys(F.col("typed"))).alias("key"))
    words = vocab.select("list_name", "word", "parts", F.explode(token_keys(F.col("word"), short=False)).alias("key"))
    pairs = keyed.join(hint(words), ["list_name", "key"]).select("list_name", "token", "typed", "word", "parts").distinct()
    scored = pairs.withColumn("sim", token_similarity(F.col("typed"), F.col("word"), F.size("parts"))).where("sim is not null")
    return scored.groupBy("list_name", "token", "parts").agg(F.max("sim").alias("sim"))


def match_values(values: DataFrame, entries: DataFrame, accept: float = ACCEPT, short_forms: dict[str, str] | None = None, around: str | None = AROUND) -> DataFrame:
    """``list_name, value, entry_id, score`` for distinct ``(list_name, value)``; -1 where no entry is meant.

    Soft TF-IDF: every word of an entry takes the best repair the value offers for it; what the value
    says beyond that counts against the match with the weight of a rare word. Ties go to the smaller
    entry id. Null values give no row; a value without letters or without known words gives -1.
    ``short_forms`` (of words) and ``around`` (what may surround a value) are what the caller knows of
    how such values are written; both may be left out.
    """
    small = entries.count() <= BROADCAST_ENTRIES
    hint = F.broadcast if small else (lambda x: x)
    spread = values.where("value is not null").select("list_name", "value", value_tokens(F.col("value"), around).alias("tokens"))
    each = spread.select("list_name", "value", F.explode(F.array_distinct("tokens")).alias("token"))
    repairs = repair_tokens(each.select("list_name", "token").distinct(), vocabulary(entries), small, short_forms)
    weights = entry_tokens(entries)
    rare = hint(weights.groupBy("list_name").agg(F.log1p(F.first("n").cast("double")).alias("rare")))
    # A token's own weight: that of the best word it may stand for, else that of a rare word; one or two stray letters weigh little.
    idf = weights.groupBy("list_name", "token").agg(F.first("idf").alias("idf")).withColumnRenamed("token", "part")
    parts = repairs.select("list_name", "token", "sim", F.posexplode("parts").alias("pos", "part"), F.size("parts").alias("of"), F.col("parts").alias("all_parts"))
    parts = parts.join(hint(idf), ["list_name", "part"])
    own = parts.groupBy("list_name", "token", "all_parts").agg(F.max("sim").alias("sim"), F.sum(F.col("idf") * F.col("idf")).alias("w2"))
    own = own.groupBy("list_name", "token").agg(F.max_by("w2", F.struct("sim", "w2")).alias("w2"))
    stray = F.when(F.length("token") <= 2, F.lit(0.15)).otherwise(F.lit(1.0)) * F.col("rare") * F.col("rare")
    norm = each.join(own, ["list_name", "token"], "left").join(rare, "list_name").groupBy("list_name", "value").agg(F.sqrt(F.sum(F.coalesce("w2", stray))).alias("value_norm"))
    # A token is one repair at a time: what it gives an entry is the best single repair.
    gain = parts.select("list_name", "token", "all_parts", "part", "sim").join(hint(weights.withColumnRenamed("token", "part")), ["list_name", "part"])
    gain = gain.groupBy("list_name", "token", "all_parts", "entry_id").agg(F.sum(F.col("sim") * F.col("idf") * F.col("idf")).alias("gain"), F.first("norm").alias("norm"))
    gain = gain.groupBy("list_name", "token", "entry_id").agg(F.max("gain").alias("gain"), F.first("norm").alias("norm"))
    met = each.join(gain, ["list_name", "token"])
    scored = met.groupBy("list_name", "value", "entry_id").agg(F.least(F.sum("gain") / F.first("norm"), F.first("norm")).alias("dot"))
    best = scored.groupBy("list_name", "value").agg(F.max_by("entry_id", F.struct(F.round("dot", 9), -F.col("entry_id"))).alias("entry_id"), F.max("dot").alias("dot"))
    out = spread.select("list_name", "value").join(best, ["list_name", "value"], "left").join(norm, ["list_name", "value"], "left")
    score = F.coalesce(F.col("dot") / F.greatest("value_norm", F.lit(1e-9)), F.lit(0.0))
    return out.select("list_name", "value", F.when(score >= accept, F.col("entry_id")).otherwise(F.lit(-1)).cast("int").alias("entry_id"), F.round(score, 6).alias("score"))


def typed_values(filings: DataFrame, demo: DataFrame) -> DataFrame:
    """``src, list_name, row_id, value`` of every row that says something in its typed field."""
    a = filings.select(F.lit("ttb_cola_sample").alias("src"), F.lit("class_type").alias("list_name"), "row_id", F.col("class_type").alias("value"))
    b = demo.select(F.lit("demo_products").alias("src"), F.lit("style").alias("list_name"), "row_id", F.col("product.style").alias("value"))
    return a.unionByName(b).where(~says_nothing(F.col("value")))


def map_typed_values(filings: DataFrame, demo: DataFrame, entries: DataFrame, short_forms: dict[str, str] | None = None, around: str | None = AROUND) -> DataFrame:
    """``src, row_id, entry_id`` of the rows whose value is not letter for letter a label of its list."""
    labels = entries.select("list_name", F.col("label").alias("value")).distinct()
    rows = typed_values(filings, demo).join(F.broadcast(labels) if entries.count() <= BROADCAST_ENTRIES else labels, ["list_name", "value"], "left_anti")
    found = match_values(rows.select("list_name", "value").distinct(), entries, ACCEPT, short_forms, around)
    return rows.join(found, ["list_name", "value"]).select("src", "row_id", "entry_id")
