"""Matching filings with catalogue products that share no identifier.

Both sides are read into brand, name words, number (age, batch, vintage), barcode and strength, and
rows that read alike become one node. Candidate pairs share one of several keys (brand and a word,
start or end of the brand and the name, brand and name written together, barcode), each of which
survives a different kind of damage; repeats never meet, because nodes are distinct before they are
paired. Every pair gets prior odds from its attributes. Loopy belief propagation then lets pairs
compete: a filing is one drink and a product is one drink, so pairs that name different drinks
exclude each other at their common node. Messages travel through joins and partial aggregates, damped,
until none moves any more; only pairs that share a node with a competitor take part, as all other
messages are one.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from cellarium.functions.stated import says_nothing, stated_abv
from cellarium.session import materialise

#: Least marginal probability of a match, and prior log-odds below which a pair is no candidate.
ACCEPT, LEAST_PRIOR = 0.5, -6.0
#: Share of its old value a message keeps, movement below which messages have settled, and rounds after
#: which a propagation that has not settled says so and stops.
DAMPING, SETTLED, MOST_ROUNDS = 0.2, 0.02, 60
#: Letters from which a word tells a brand by itself.
TELLING = 7
#: Entries of the class lists, whose labels are not part of a name, at most; they go to every task.
MOST_LABELS = 20_000

# Words that may follow a brand without being part of it.
HOUSE_WORDS = {"brewing", "brewery", "cellars", "co", "company", "spirits", "distillers", "distilling", "winery", "llc", "inc", "ltd", "estates", "beverage", "works"}

_NUMBERED = re.compile(r"(?P<joined>[a-z]*?)(?P<kind>no|batch|vintage)$")
_NAMES = StructType([StructField("brand", StringType()), StructField("words", ArrayType(StringType())), StructField("num", StringType())])


def _tokens(text: object) -> list[str]:
    if not isinstance(text, str):
        return []
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W\d_]+|\d+", plain.replace("'", ""))


def close(a: str, b: str) -> bool:
    """Equal, or long and at most two edits apart."""
    if a == b:
        return True
    if min(len(a), len(b)) < 6 or abs(len(a) - len(b)) > 2:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1] <= 2


def read_brand(text: object) -> list[str]:
    """Words of a brand without article and trailing house words."""
    t = _tokens(text)
    if len(t) > 1 and t[0] == "the":
        t = t[1:]
    while len(t) > 1 and t[-1] in HOUSE_WORDS:
        t = t[:-1]
    return t


def read_name(brand: object, name: object, labels: frozenset[str] = frozenset()) -> tuple[str, list[str], str]:
    """Brand, the words of the name, and the number of a drink.

    The name may repeat the brand in front or after "by", and may carry its class behind: words after
    the second that together are one of ``labels`` are left out, all others stay. Without a brand, a
    name of four words or more starts with it.
    """
    b, t = read_brand(brand), _tokens(name)
    if "by" in t[2:]:
        at = len(t) - 1 - t[::-1].index("by")
        t, said = t[:at], read_brand(" ".join(t[at + 1 :]))
        b = b or said
    if b and t:
        t = _without_brand(b, t)
    words, num = _without_number(t)
    words = _without_label(words, labels)
    if not b and len(words) >= 4 and len(words[0]) >= TELLING:
        b, words = words[:2], words[2:]
    return "".join(b), words, num


def _without_brand(b: list[str], t: list[str]) -> list[str]:
    """The name after the brand, which may be written together, in parts, or with errors."""
    whole = "".join(b)
    for k in range(min(len(b) + 2, len(t) - 1), 0, -1):
        if "".join(t[:k]) == whole:
            return t[k:]
    if len(t) <= len(b) or not close(t[0], b[0]):
        return t
    k = 1
    while k < len(b) and len([w for w in t[k:] if not w.isdigit()]) > 1:
        near = close(t[k], b[k]) or t[k][:3] == b[k][:3]
        if not (near or len([w for w in t if not w.isdigit()]) > 3 and t[k][0] == b[k][0]):
            break
        k += 1
    # One word of several is the brand only if it tells it.
    return t[k:] if k > 1 or len(b) == 1 or len(t[0]) >= TELLING else t


def _without_number(t: list[str]) -> tuple[list[str], str]:
    """The words of a name, and its first number with what it counts: years, batch, vintage or number."""
    num, words, skip = "", [], -1
    for i, w in enumerate(t):
        if i == skip:
            continue
        if not w.isdigit():
            words.append(w)
        elif not num and i + 1 < len(t) and t[i + 1][0] == "y":
            num, skip = f"y{int(w)}", i + 1
        elif num or not i:
            words.append(w)
        else:
            kind = _NUMBERED.match(t[i - 1])
            if kind:
                num = f"{kind['kind'][0]}{int(w)}"
                words[-1:] = [kind["joined"]] if kind["joined"] else []
            elif t[i - 1][0] in "nbv" and i >= 2:
                num, words = f"{t[i - 1][0]}{int(w)}", words[:-1]
            else:
                num = f"y{int(w)}"
    return words, num


def _without_label(words: list[str], labels: frozenset[str]) -> list[str]:
    """The words without the class behind them, which may be cut or mistyped."""
    for i in range(2, len(words)):
        tail = " ".join(words[i:])
        if tail in labels or len(tail) >= 3 and any(x[0] == tail[0] and (x.startswith(tail) or close(x, tail)) for x in labels):
            return words[:i]
    return words


def names_udf(labels: frozenset[str]) -> Callable[[Column, Column], Column]:
    """Reads each distinct brand and name of an Arrow batch once."""

    @F.pandas_udf(_NAMES)
    def names(brands: pd.Series, names: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(pd.Series(list(zip(brands, names)), dtype=object))
        rows = pd.DataFrame([read_name(b, n, labels) for b, n in distinct], columns=["brand", "words", "num"])
        return rows.take(codes).reset_index(drop=True)

    return names


def class_labels(entries: DataFrame | None) -> frozenset[str]:
    """The labels of the class lists as words; a reference table of checked size."""
    if entries is None:
        return frozenset()
    rows = entries.select("label").distinct().limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} class labels")
    return frozenset(" ".join(_tokens(r["label"])) for r in rows) - {""}


def barcode_key(upc: Column) -> Column:
    """The twelve digits of a barcode: formats and the thirteen-digit form with a leading zero agree, and
    a missing check digit is worked out. Null for anything shorter or longer or one repeated digit."""
    digits = F.regexp_replace(upc, "[^0-9]", "")
    digits = F.when((F.length(digits) > 12) & digits.startswith("0"), F.regexp_replace(digits, "^0+", "")).otherwise(digits)
    at = lambda i: F.substring(digits, i, 1).cast("int")
    check = F.pmod(-(3 * sum(at(i) for i in range(1, 12, 2)) + sum(at(i) for i in range(2, 11, 2))), F.lit(10))
    whole = F.when(F.length(digits) == 12, digits).when(F.length(digits) == 11, F.concat(digits, check.cast("string")))
    return F.when(~digits.rlike(r"^(\d)\1+$"), whole)


def _node(df: DataFrame, ids: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with what they say, and which ids say it."""
    said = ["brand", "words", "num", "upc"]
    df = df.withColumn(out, F.xxhash64(F.coalesce("brand", F.lit("")), F.concat_ws(" ", "words"), "num", F.coalesce("upc", F.lit(""))))
    members = df.select(out, F.col(ids)).distinct()
    nodes = df.groupBy(out).agg(*[F.first(c).alias(c) for c in said], F.min("abv").alias("abv_low"), F.max("abv").alias("abv_high"))
    return nodes, members


def filing_nodes(filings: DataFrame, labels: frozenset[str] = frozenset()) -> tuple[DataFrame, DataFrame]:
    stated = lambda c: F.when(~says_nothing(F.col(c)), F.col(c))
    f = filings.where("ttb_id is not null").select("ttb_id", stated("brand_name").alias("b"), stated("fanciful_name").alias("n"), barcode_key(F.col("upc")).alias("upc"), stated_abv(F.col("abv"), F.col("class_type")).alias("abv"))
    f = f.distinct().withColumn("p", names_udf(labels)("b", "n")).select("ttb_id", "upc", "abv", "p.brand", "p.words", "p.num")
    return _node(f, "ttb_id", "l")


def product_nodes(gold: DataFrame, labels: frozenset[str] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """Products with the brand their brand record names; where that record is missing, the brand is what
    the name itself starts with, if anything."""
    shape = "brand_id string, name string, aliases array<string>, style struct<value:string>, spec struct<abv_pct:struct<value:double>>"
    stated = lambda c: F.when(~says_nothing(c), c)
    p = gold.where("entity_type = 'product'").select(F.col("id").alias("gold_id"), F.from_json("record", shape).alias("r"))
    p = p.select("gold_id", F.col("r.brand_id").alias("brand_id"), F.coalesce(stated(F.col("r.name")), F.get(F.filter("r.aliases", lambda a: ~says_nothing(a)), F.lit(0))).alias("n"), stated_abv(F.col("r.spec.abv_pct.value"), F.col("r.style.value"), F.col("r.name")).alias("abv"))
    brands = gold.where("entity_type = 'brand'").select(F.col("id").alias("brand_id"), F.get_json_object("record", "$.name").alias("b")).where(~says_nothing(F.col("b")))
    sku = gold.where("entity_type = 'sku'").select(F.get_json_object("record", "$.product_id").alias("gold_id"), barcode_key(F.get_json_object("record", "$.upc")).alias("upc")).where("upc is not null and gold_id is not null")
    read = p.join(brands, "brand_id", "left").withColumn("p", names_udf(labels)("b", "n")).join(sku, "gold_id", "left")
    return _node(read.select("gold_id", "upc", "abv", "p.brand", "p.words", "p.num"), "gold_id", "r")


def with_drinks(nodes: DataFrame) -> DataFrame:
    """Add ``drink``: the drink a product node stands for where it competes with others.

    A drink is known by its brand, words and number as they are spelled, or by the most frequent
    spelling among nodes that begin alike if that is at most two edits away: one drink spelled two ways
    is no rival of itself. The beginnings only say where to look.
    """
    words = F.array_sort("words")
    spelled = F.concat_ws("|", "brand", F.array_join(words, " "), "num")
    block = F.xxhash64(F.substring("brand", 1, 4), F.array_join(F.transform(words, lambda w: F.substring(w, 1, 2)), ""), "num")
    n = nodes.withColumn("spelled", spelled).withColumn("block", block)
    usual = n.groupBy("block", "spelled").agg(F.count("*").alias("n")).groupBy("block").agg(F.min(F.struct((-F.col("n")).alias("n"), "spelled"))["spelled"].alias("usual"))
    drink = F.when(F.levenshtein("spelled", "usual", 2) >= 0, F.col("usual")).otherwise(F.col("spelled"))
    return n.join(usual, "block").withColumn("drink", drink).drop("block", "spelled", "usual")


def _keys() -> Column:
    b, words, num = F.col("brand"), F.col("words"), F.coalesce("num", F.lit(""))
    both = F.array_join(F.array_sort(words), "")
    has_b, has_w = F.length("brand") >= 4, F.size("words") > 0
    key = lambda tag, *parts: F.concat_ws("|", F.lit(tag), *parts)
    word = F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.when(has_b, key("w", b, w, num)))
    start = F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.when(F.length("brand") >= 6, key("b", F.substring(b, 1, 6), w, num)))
    one = [
        F.when(has_b & has_w, key("s", F.substring(b, 1, 4), both, num)),
        F.when(has_b & has_w, key("e", F.substring(b, -4, 4), both, num)),
        F.when(has_w, key("c", F.concat(F.coalesce(b, F.lit("")), F.array_join(words, "")), num)),
        F.when(has_w, key("c", F.concat(F.coalesce(b, F.lit("")), F.array_join(F.reverse(words), "")), num)),
        F.when(F.col("upc").isNotNull(), key("u", F.col("upc"))),
    ]
    return F.array_distinct(F.filter(F.concat(word, start, F.array(*one)), lambda k: k.isNotNull()))


def letter_bits(text: str) -> Column:
    """Two bits a letter of a column, for its first and its second place: an edit changes two of them at most, and
    what a text begins with has none that the text lacks."""
    return F.expr(f"aggregate(split({text}, ''), 0L, (m, c) -> m | if(m & shiftleft(1L, ascii(c) & 31) = 0, shiftleft(1L, ascii(c) & 31), shiftleft(1L, 32 + (ascii(c) & 31))))")


def _keyed(nodes: DataFrame, node: str, side: str) -> DataFrame:
    """Hashed keys of nodes with what tells whether a pair can be kept."""
    tell = nodes.select(node, "brand", "words", "num", "upc", (F.length("brand")).alias("letters"), F.floor(F.col("abv_low") * 10).cast("int").alias("low"), F.ceil(F.col("abv_high") * 10).cast("int").alias("high"), F.array_join("words", "").alias("joined"))
    tell = tell.withColumn("b", letter_bits("brand")).withColumn("n", letter_bits("joined")).withColumn("numbered", F.coalesce("num", F.lit("")) != "").withColumn("coded", F.col("upc").isNotNull())
    own = ["b", "n", "letters", "low", "high", "numbered", "coded"]
    keys = tell.select(node, *own, F.explode(_keys()).alias("key"))
    return keys.select(node, F.xxhash64("key").alias("key"), F.substring("key", 1, 1).isin("s", "b", "e").alias("loose"), *own).select(node, "key", *[F.col(c).alias(f"{side}_{c}") for c in ("loose", *own)])


def _can_be_kept() -> Column:
    """False only for pairs of a key with part of the brand whose prior odds are too low.

    Brands that are not alike take five off, so without a common barcode only names at most two edits
    apart make up for them, and only with a number or a strength in common (one more if barcodes differ).
    """
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    differ = lambda c: F.bit_count(a(c).bitwiseXOR(b(c)))
    lacks = lambda x, y: x.bitwiseAND(F.bitwise_not(y)) == 0
    brand = (differ("b") <= 0.4 * F.greatest(a("letters"), b("letters")) + 1e-6) | lacks(a("b"), b("b")) | lacks(b("b"), a("b"))
    off = F.greatest(a("low") - b("high"), b("low") - a("high"))
    strength = F.when(off.isNull(), 0).when(off <= 4, 1).when(off <= 11, 0).otherwise(-1)
    speaks = F.when(a("numbered"), 1).otherwise(0) + strength - F.when(a("coded") & b("coded"), 1).otherwise(0)
    return ~a("loose") | brand | (differ("n") <= 4) & (speaks >= 1)


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct ``l, r`` that share a key, with what both sides say.

    Many brands begin or end alike, so those keys meet pairs by the square of the rows; pairs whose prior
    odds can only be too low are dropped where they meet, before they travel.
    """
    a, b = _keyed(left, "l", "a"), _keyed(right, "r", "b").withColumnRenamed("key", "b_key")
    pairs = a.join(b, (F.col("key") == F.col("b_key")) & _can_be_kept()).select("l", "r").distinct()
    side = lambda df, k, x: df.select(k, *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c != k])
    return pairs.join(side(left, "l", "a"), "l").join(side(right, "r", "b"), "r")


def score_pairs(pairs: DataFrame) -> DataFrame:
    """``l, r, prior, l_rival, r_rival``: log-odds of each pair and which drink it stands for at either node.

    Pairs that agree in full stand for the node's own drink; partial and blank names stand for the
    drink of the product at the filing, and conflicting ones for the other side's drink at both.
    """
    part = lambda x, c: F.col(f"{x}_{c}")
    ab, bb = F.coalesce(part("a", "brand"), F.lit("")), F.coalesce(part("b", "brand"), F.lit(""))
    sim = lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    aw, bw = F.array_join(F.array_sort(part("a", "words")), ""), F.array_join(F.array_sort(part("b", "words")), "")
    flat_a, flat_b, turned_a = F.array_join(part("a", "words"), ""), F.array_join(part("b", "words"), ""), F.array_join(F.reverse(part("a", "words")), "")
    # Brand and name may be parted differently; written together they agree.
    together = (ab != "") & (bb != "") & (F.concat(ab, flat_a) == F.concat(bb, flat_b))
    pairs = pairs.withColumn("together", together)
    p = pairs.withColumn("bs", F.when((ab == "") | (bb == ""), None).otherwise(sim(ab, bb))).withColumn("nd", F.when((aw == "") | (bw == ""), None).otherwise(F.least(F.levenshtein(aw, bw), F.levenshtein(flat_a, flat_b), F.levenshtein(turned_a, flat_b))))
    begins = (F.least(F.length(ab), F.length(bb)) >= 5) & (F.startswith(ab, bb) | F.startswith(bb, ab))
    shared = F.size(F.array_intersect(part("a", "words"), part("b", "words"))) > 0
    shorter = (F.size(part("a", "words")) < 2) | (F.size(part("b", "words")) < 2) | F.startswith(flat_a, flat_b) | F.startswith(flat_b, flat_a)
    # A name cut in the middle of a word may be the longer one; one that lacks a whole word is another name.
    spaced_a, spaced_b = F.array_join(part("a", "words"), " "), F.array_join(part("b", "words"), " ")
    longer = (F.size(part("a", "words")) >= 2) & (F.size(part("b", "words")) >= 2) & (F.startswith(spaced_a, F.concat(spaced_b, F.lit(" "))) | F.startswith(spaced_b, F.concat(spaced_a, F.lit(" "))))
    partial = shared & shorter & ~longer
    same_num = F.coalesce(part("a", "num"), F.lit("")) == F.coalesce(part("b", "num"), F.lit(""))
    brand = F.when(F.col("together"), 3.0).when(F.col("bs").isNull(), 0.0).when(F.col("bs") == 1, 3.0).when(F.col("bs") >= 0.8, 2.2).when(begins, 1.5).otherwise(-5.0)
    name = F.when(F.col("together"), 3.0).when(F.col("nd").isNull(), 0.0).when(F.col("nd") == 0, 3.0).when(F.col("nd") <= 2, 2.2).when(partial, 1.0).when(longer, -2.0).otherwise(-5.0)
    blank = F.col("nd").isNull()
    number = F.when(blank, 0.0).when(same_num & (F.coalesce(part("a", "num"), F.lit("")) != ""), 1.0).when(same_num, 0.0).otherwise(-7.0)
    code = F.when(part("a", "upc").isNull() | part("b", "upc").isNull(), 0.0).when(part("a", "upc") == part("b", "upc"), 5.0).otherwise(-1.0)
    off = F.greatest(part("a", "abv_low") - part("b", "abv_high"), part("b", "abv_low") - part("a", "abv_high"))
    strength = F.when(off.isNull(), 0.0).when(off <= 0.3, 1.0).when(off <= 1.0, 0.0).otherwise(-1.5)
    full = (F.col("together") | (F.coalesce("bs", F.lit(0.0)) >= 0.8) & (F.coalesce("nd", F.lit(9)) <= 2)) & same_num
    drink = lambda x: F.concat_ws("|", part(x, "brand"), F.array_join(F.array_sort(part(x, "words")), ""), part(x, "num"))
    fits = ((brand > 0) | (F.col("bs").isNull())) & ((name > 0) | blank) & (same_num | blank)
    return p.select("l", "r", (brand + name + number + code + strength - 4.0).alias("prior"), F.when(full, F.lit("")).otherwise(part("b", "drink")).alias("l_rival"), F.when(fits, F.lit("")).otherwise(drink("a")).alias("r_rival"))


def propagate(scored: DataFrame, most_rounds: int = MOST_ROUNDS, told_of: list[tuple[int, float]] | None = None) -> DataFrame:
    """``l, r, prob``: marginal probability of every candidate pair.

    A pair has one row per node, so both factors send their messages in the same joins: to a pair at
    a node, minus log of one plus the odds of the node's other drinks. Odds of a drink are those of
    its best pair. Every round's number and greatest movement are appended to ``told_of``; a run that
    reaches ``most_rounds`` unsettled warns.
    """
    scored = materialise(scored.where(F.col("prior") > LEAST_PRIOR))
    ends = lambda df, *keep: df.select("l", "r", *keep, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("l").alias("node"), F.col("l_rival").alias("rival")), F.struct(F.lit(1).alias("side"), F.col("r").alias("node"), F.col("r_rival").alias("rival")))).alias("end")).select("l", "r", *keep, "end.*")
    contested = ends(scored).groupBy("side", "node").agg(F.min("rival").alias("a"), F.max("rival").alias("b")).where("a <> b").select("side", "node")
    tied = ends(scored).join(contested, ["side", "node"], "left_semi").select("l", "r").distinct().withColumn("tied", F.lit(True))
    marked = scored.join(tied, ["l", "r"], "left")
    free = marked.where("tied is null").select("l", "r", F.col("prior").alias("logodds"))
    now = materialise(marked.where("tied").select("l", "r", "prior", "l_rival", "r_rival", F.array(F.lit(0.0), F.lit(0.0)).alias("m"), F.lit(0.0).alias("moved")))
    moved: float | None = float("inf")
    for round_ in range(1, most_rounds + 1):
        # What a pair tells a node leaves out what the node told the pair.
        told = ends(now.withColumn("total", F.col("prior") + F.col("m")[0] + F.col("m")[1]), "m", "total").withColumn("told", F.col("total") - F.get("m", F.col("side")))
        best = told.groupBy("side", "node", "rival").agg(F.max(F.exp(F.least("told", F.lit(30.0)))).alias("best"))
        node = best.groupBy("side", "node").agg(F.sum("best").alias("total"))
        sent = told.select("l", "r", "side", "node", "rival").join(best, ["side", "node", "rival"]).join(node, ["side", "node"])
        message = -F.log1p(F.greatest(F.col("total") - F.col("best"), F.lit(0.0)))
        got = sent.groupBy("l", "r").agg(F.max(F.when(F.col("side") == 0, message)).alias("m0"), F.max(F.when(F.col("side") == 1, message)).alias("m1"))
        keep = DAMPING if round_ > 1 else 0.0
        damped = [F.col(f"m{i}") * (1 - keep) + F.col("m")[i] * keep for i in (0, 1)]
        step = F.greatest(*[F.abs(F.col(f"m{i}") - F.col("m")[i]) for i in (0, 1)])
        now = materialise(now.drop("moved").join(got, ["l", "r"]).select("l", "r", "prior", "l_rival", "r_rival", F.array(*damped).alias("m"), step.alias("moved")))
        moved = now.agg(F.max("moved")).first()[0]
        if told_of is not None:
            told_of.append((round_, moved or 0.0))
        if moved is None or moved < SETTLED:
            break
    else:
        warnings.warn(f"messages still move by {moved:.3g} after {most_rounds} rounds", stacklevel=2)
    settled = now.select("l", "r", (F.col("prior") + F.col("m")[0] + F.col("m")[1]).alias("logodds"))
    return free.unionByName(settled).select("l", "r", (1 / (1 + F.exp(-F.col("logodds")))).alias("prob"))


def match_entities(filings: DataFrame, gold: DataFrame, entries: DataFrame | None = None, accept: float = ACCEPT, told_of: list[tuple[int, float]] | None = None) -> DataFrame:
    """``ttb_id, gold_id, confidence`` of every accepted pair, each once.

    ``entries`` are the class lists, whose labels a name may carry behind. Null and blank attributes
    neither help nor hurt. Rows without an id are left out. Empty tables give an empty result.
    """
    labels = class_labels(entries)
    left, left_ids = filing_nodes(filings, labels)
    right, right_ids = product_nodes(gold, labels)
    left, right = materialise(left), with_drinks(materialise(right))
    found = propagate(score_pairs(candidate_pairs(left, right)), told_of=told_of).where(F.col("prob") >= accept)
    return found.join(left_ids, "l").join(right_ids, "r").groupBy("ttb_id", "gold_id").agg(F.round(F.max("prob"), 6).alias("confidence"))
