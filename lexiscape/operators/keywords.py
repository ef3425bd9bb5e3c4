"""Keyword analytics over (id, keywords)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscape.functions.columns import bigrams, nfkc, similar
from lexiscape.session import Scratch


def exploded(rows: DataFrame, key: str, words: str, normal=F.trim, stop: list[str] = (), compose: bool = False) -> DataFrame:
    """(id, w): each document's different keywords, normalised (by compatibility composition first, if asked)."""
    out = rows.select(F.col(key).alias("id"), F.explode(words).alias("w"))
    out = out.withColumn("w", normal(nfkc(F.col("w")) if compose else F.col("w"))).where("w <> ''")
    return (out.where(~F.col("w").isin(list(stop))) if stop else out).dropDuplicates(["id", "w"])


def atypicality(words: DataFrame, documents: int, least: int = 5) -> DataFrame:
    """id, kw_atyp, kw_npairs: minus the 10th percentile (linear) of z = (o - e) / sqrt(e) over a document's pairs."""
    f = words.groupBy("w").agg(F.count("*").alias("f")).where(F.col("f") >= least)
    kept = words.join(f, "w")
    a, b = kept.select("id", F.col("w").alias("a"), F.col("f").alias("fa")), kept.select("id", F.col("w").alias("b"), F.col("f").alias("fb"))
    pairs = a.join(b, "id").where("a < b")
    seen = pairs.groupBy("a", "b").agg(F.count("*").alias("o"), F.first("fa").alias("fa"), F.first("fb").alias("fb"))
    e = F.col("fa") * F.col("fb") / F.lit(float(documents))
    z = seen.select("a", "b", ((F.col("o") - e) / F.sqrt(e)).alias("z"))
    return pairs.select("id", "a", "b").join(z, ["a", "b"]).groupBy("id").agg((-F.percentile("z", 0.1)).alias("kw_atyp"), F.count("*").alias("kw_npairs"))


def region_scores(words: DataFrame, regions: DataFrame, n_in_least: int = 5, share: float = 0.01, smooth: float = 30.0, power: float = 0.5) -> DataFrame:
    """region, w, n_in, n_all, score = w_in / (n_all + smooth) * w_in ** power. regions: id, region, wt."""
    n_all = words.groupBy("w").agg(F.count("*").alias("n_all"))
    size = regions.groupBy("region").agg(F.countDistinct("id").alias("docs"))
    own = words.join(regions, "id").groupBy("region", "w").agg(F.count("*").alias("n_in"), F.sum("wt").alias("w_in"))
    out = own.join(n_all, "w").join(size, "region").where((F.col("n_in") >= n_in_least) & (F.col("n_in") >= share * F.col("docs")))
    return out.select("region", "w", "n_in", "n_all", (F.col("w_in") / (F.col("n_all") + smooth) * F.pow("w_in", F.lit(power))).alias("score"))


def top(scores: DataFrame, group: str, k: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc(F.round("score", 9)), "w")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distinct_words(ranked: Column, k: int = 8) -> Column:
    """Greedy fold over words in order of rank: one similar to a kept word is skipped."""
    none = F.array().cast("array<string>")
    return F.slice(F.aggregate(ranked, none, lambda kept, w: F.when(F.exists(kept, lambda x: similar(x, w)), kept).otherwise(F.concat(kept, F.array(w)))), 1, k)


def similar_pairs(words: DataFrame, word: str = "w") -> DataFrame:
    """a, b (a < b): all pairs of different words that are alike (`similar`), without meeting all pairs.

    Of two alike words, the one with the fewer bigrams shares half of them with the other. With bigrams in order of rarity, the
    two so share one among the first of each that would otherwise be too few to miss it, and only such pairs meet. A word that holds another of
    two letters or more has all its bigrams; words without a bigram meet those that have their letter, and the empty word meets all.
    """
    scratch = Scratch(words.sparkSession)
    n = scratch.table(words.select(F.col(word).alias("w")).where("w is not null").distinct().withColumn("g", bigrams(F.col("w"))).withColumn("n", F.size("g")))
    each = n.where("n > 0").select("w", "n", F.explode("g").alias("t"))
    rare = each.groupBy("t").agg(F.count("*").alias("df"))
    placed = scratch.table(each.join(rare, "t").withColumn("at", F.row_number().over(Window.partitionBy("w").orderBy("df", "t"))))  # as many rows as the word has letters
    need = F.ceil(F.col("n") / 2)  # bigrams that the smaller word shares
    x = placed.where(F.col("at") <= F.col("n") - need + 1).select("t", F.col("w").alias("x"), F.col("n").alias("nx"), need.alias("need"))
    y = placed.select("t", F.col("w").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"))
    smaller = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    met = x.join(y, "t").where(smaller & (F.col("ay") <= F.col("ny") - F.col("need") + 1)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    alike = met.where(similar(F.col("a"), F.col("b")))
    letters = n.where("w <> ''").select("w", F.explode(F.array_distinct(F.split("w", ""))).alias("t")).where("t <> ''")
    short = n.where("n = 0 and w <> ''").select(F.col("w").alias("t"), F.col("w").alias("x"))
    held = letters.join(short, "t").where("w <> x").select(F.least("w", "x").alias("a"), F.greatest("w", "x").alias("b"))
    every = n.where("w <> ''").select(F.lit("").alias("a"), F.col("w").alias("b"))
    return alike.unionByName(held).unionByName(every if n.where("w = ''").limit(1).count() else every.limit(0)).distinct()


def feature_words(scores: DataFrame, group: str = "region", candidates: int = 60, keep: int = 8) -> DataFrame:
    """group, words: the best words that aren't alike."""
    t = top(scores, group, candidates)
    return t.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "w"))), lambda s: s["w"]).alias("ranked")).select(group, distinct_words(F.col("ranked"), keep).alias("words"))


def cluster_terms(words: DataFrame, clusters: DataFrame, common: int = 60, least: int = 3, keep: int = 6) -> DataFrame:
    """cluster, w, v, rank: of a cluster's most common words, those of largest v * min(1, 5 v / v_all)."""
    v_all = words.groupBy("w").agg(F.count("*").alias("v_all"))
    v = words.join(clusters, "id").groupBy("cluster", "w").agg(F.count("*").alias("v"))
    first = Window.partitionBy("cluster").orderBy(F.desc("v"), "w")
    v = v.withColumn("c", F.row_number().over(first)).where((F.col("c") <= common) & (F.col("v") >= least)).join(v_all, "w")
    score = F.col("v") * F.least(F.lit(1.0), 5 * F.col("v") / F.col("v_all"))
    return top(v.select("cluster", "w", "v", score.alias("score")), "cluster", keep).select("cluster", "w", "v", "score", "rank")


def weighted_sample(rows: DataFrame, group: str, weight: str, u: Column, k: int, key: str = "id") -> DataFrame:
    """k rows a group without replacement, by weight: the smallest -ln(u) / w. u: a number in (0, 1] of the key."""
    t = rows.where(F.col(weight) > 0).withColumn("draw", -F.log(u) / F.col(weight))
    order = Window.partitionBy(group).orderBy(F.round("draw", 9), key)
    return t.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def names_or_words(places: DataFrame, names: DataFrame) -> DataFrame:
    """region, label: a given name, or else the first two feature words."""
    return places.join(names, "region", "left").select("region", F.coalesce("name", F.array_join(F.slice("words", 1, 2), " / ")).alias("label"))


def sector_words(words: DataFrame, sectors: DataFrame, least: int = 30, smooth: float = 30.0, k: int = 4) -> DataFrame:
    """sector, w, n_in, n_all, score, rank: words of at least `least` rows of a sector by their share there. sectors: id, sector."""
    n_all = words.groupBy("w").agg(F.count("*").alias("n_all"))
    own = words.join(sectors, "id").groupBy("sector", "w").agg(F.count("*").alias("n_in")).where(F.col("n_in") >= least).join(n_all, "w")
    return top(own.withColumn("score", F.col("n_in") / (F.col("n_all") + smooth)), "sector", k)


def selection_words(words: DataFrame, selected: DataFrame, k: int = 15) -> DataFrame:
    """w, n, rank: the most common keywords of selected rows (id); only the best k meet in one task."""
    n = words.join(selected.select("id"), "id", "left_semi").groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(k)
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "w")))


def namer_prompt(words: list[str], titles: list[str], taken: list[str] = ()) -> str:
    """What a namer is asked: a short name of a region, from its words and titles, unlike the names that are taken."""
    lines = ["Give a short place name (4 to 12 characters, a noun) to a region of a map of research.", "Words: " + ", ".join(words), "Titles:", *(f"- {t}" for t in titles)]
    return "\n".join([*lines, "Not one of: " + ", ".join(taken)] if taken else lines)


def level_prompt(level: Column, places: Column, n: Column, total: Column, parent: Column, words: Column, texts: Column) -> Column:
    """The same for a level of the map: a coarse region covers much, a fine one says what it is within its parent; texts are sampled bodies."""
    fine = F.when(parent.isNotNull(), F.concat(F.lit("It is a part of the region '"), parent, F.lit("': say what it is within that."))).otherwise(F.concat(F.lit("The whole map has about "), places.cast("string"), F.lit(" such regions.")))
    scope = F.when(level == 0, F.concat(F.lit("It is one of about "), places.cast("string"), F.lit(" coarse regions of the whole map: take a wide name that covers it all."))).otherwise(fine)
    head = F.concat(F.lit("Give a short place name (4 to 12 characters, a noun) to a region of "), n.cast("string"), F.lit(" of the "), total.cast("string"), F.lit(" items of a map of research."))
    bodies = F.concat_ws("\n\n", F.transform(texts, lambda t, i: F.concat(F.lit("--- "), (i + 1).cast("string"), F.lit(" ---\n"), t)))
    return F.concat_ws("\n", head, scope, F.concat(F.lit("Words: "), F.concat_ws(", ", words)), F.lit("Items, most of them from its middle:"), bodies)


def named(rows: DataFrame, ask, tries: int = 3) -> DataFrame:
    """region, name, attempts, problem for rows (region, prompt): ask(prompt) proposes, records.name_ok's rule decides, complaints go into the next try.

    The name is null after the last try, or when ask fails; problem says why. Asked in the tasks, a row at a time; names that are there already
    are left out by the caller, so that only failures are asked again.
    """
    import re

    from lexiscape.operators.records import NAME_CHARACTERS, NAME_LENGTH

    def each(batches):
        import pandas as pd

        for b in batches:
            out = []
            for region, prompt in zip(b["region"], b["prompt"]):
                name, asked, problem = None, prompt, None
                for i in range(tries):
                    try:
                        got = ask(asked) or ""
                    except Exception as e:  # one failure doesn't stop the others; the caller asks again
                        problem = f"{type(e).__name__}: {e}"
                        break
                    bad = [m for ok, m in ((re.search(NAME_CHARACTERS, got), "it has characters that are not allowed"), (NAME_LENGTH[0] <= len(got) <= NAME_LENGTH[1], "it must have 4 to 12 characters")) if not ok]
                    problem = "; ".join(bad) or None
                    if not bad:
                        name = got
                        break
                    asked = f"{prompt}\nThe last answer {got!r} will not do: {problem}."
                out.append((region, name, i + 1, problem))
            yield pd.DataFrame(out, columns=["region", "name", "attempts", "problem"])

    return rows.select("region", "prompt").mapInPandas(each, "region int, name string, attempts int, problem string")


def parents(members: DataFrame) -> DataFrame:
    """level, region, parent: the region one level up that has the most of a region's members; ties: the smaller one. members: level, region, id."""
    up = members.select((F.col("level") + 1).alias("level"), "id", F.col("region").alias("parent"))
    n = members.select("level", "region", "id").join(up, ["level", "id"]).groupBy("level", "region", "parent").agg(F.count("*").alias("n"))
    return n.groupBy("level", "region").agg(F.max(F.struct("n", (-F.col("parent")).alias("p"))).alias("x")).select("level", "region", (-F.col("x.p")).alias("parent"))


def named_levels(places: DataFrame, members: DataFrame, ask, folder: str, sample: int = 30, longest: int = 400, tries: int = 3) -> DataFrame:
    """level, region, name, parent, attempts, problem: names of all levels, coarse ones first, whose names their parts are told.

    places: level, region, words; members: level, region, id, text, wt (the share by which a member is drawn as a sample; texts are cut
    to `longest` characters). Every level's answers go into `folder` as soon as they are there, a row an attempt at a region; a run asks only
    for regions that have no name there, so that a stopped or failed run goes on where it was. A level whose parents' names are missing is asked without them.
    """
    spark = places.sparkSession
    schema = "level int, region int, name string, attempts int, problem string, run long"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    state = lambda: spark.read.schema(schema).parquet(folder) if store.exists(path) else spark.createDataFrame([], schema)
    latest = lambda: state().groupBy("level", "region").agg(F.max_by("name", F.struct(F.col("name").isNotNull(), "run")).alias("name"), F.sum("attempts").cast("int").alias("attempts"), F.max_by("problem", F.struct(F.col("name").isNotNull(), "run")).alias("problem"))
    above = parents(members)
    size = members.groupBy("level", "region").agg(F.count("*").alias("n"))
    total = members.groupBy("level").agg(F.countDistinct("id").alias("total")).join(places.groupBy("level").agg(F.count("*").alias("places")), "level")
    chance = F.pmod(F.xxhash64("id", "region", "level"), F.lit(1_000_003)) / F.lit(1_000_004.0)
    order = F.round(-F.log(chance + F.lit(1e-6)) / F.greatest(F.col("wt"), F.lit(1e-6)), 9)
    drawn = members.withColumn("r", F.row_number().over(Window.partitionBy("level", "region").orderBy(order, "id"))).where(F.col("r") <= sample)
    texts = drawn.groupBy("level", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring(F.coalesce("text", F.lit("")), 1, longest).alias("t")))), lambda s: s["t"]).alias("texts"))  # `sample` rows
    asked = Scratch(spark).table(places.select("level", "region", "words").join(size, ["level", "region"]).join(total, "level").join(texts, ["level", "region"]).join(above, ["level", "region"], "left"))
    for level in sorted(r["level"] for r in asked.select("level").distinct().collect()):  # a row a level
        have = latest().where("name is not null")
        todo = asked.where(F.col("level") == level).join(have.select("level", "region"), ["level", "region"], "left_anti")
        told = todo.join(have.where(F.col("level") == level - 1).select(F.col("region").alias("parent"), F.col("name").alias("parent_name")), "parent", "left")
        c = F.col
        prompts = told.select("region", level_prompt(c("level"), c("places"), c("n"), c("total"), c("parent_name"), c("words"), c("texts")).alias("prompt"))
        run = (state().agg(F.max("run")).first()[0] or 0) + 1
        named(prompts, ask, tries).select(F.lit(level).cast("int").alias("level"), "region", "name", "attempts", "problem", F.lit(run).cast("long").alias("run")).write.mode("append").parquet(folder)
    return asked.select("level", "region", "parent").join(latest(), ["level", "region"], "left").select("level", "region", "name", "parent", "attempts", "problem")
