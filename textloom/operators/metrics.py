"""Tokenizer-quality metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.functions import segments as S

TINY = 1e-9


def at_least_one(c: Column) -> Column:
    return F.greatest(c, F.lit(1))


def ratio(a: Column, b: Column) -> Column:
    """a / b, where b counts as one if it is below."""
    return a.cast("double") / at_least_one(b)


def entropies(counts: DataFrame, by: list[str], alpha: float = 2.5, vocab_size: int | None = None) -> DataFrame:
    """Shannon and Renyi entropy (bits) and Renyi efficiency of (by, token, n) counts.

    The efficiency divides by the bits of the types that occur, and with
    ``vocab_size`` (as ``renyi_efficiency_vocab``) also by those of the vocabulary.
    """
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
    p = F.col("n") / F.col("total")
    joined = counts.join(total, by) if by else counts.crossJoin(F.broadcast(total))  # one row
    sums = joined.groupBy(*by).agg(
        F.first("total").alias("tokens"), F.first("types").alias("types"), (-F.sum(p * F.log2(p))).alias("shannon"), F.sum(F.pow(p, F.lit(alpha))).alias("_power")
    )
    renyi = F.log2("_power") / (1 - alpha) if abs(alpha - 1) > TINY else F.col("shannon")
    out = sums.withColumn("renyi", renyi)
    out = out.withColumn("renyi_efficiency", F.col("renyi") / F.log2(F.greatest("types", F.lit(2)))).drop("_power")
    return out.withColumn("renyi_efficiency_vocab", F.col("renyi") / F.log2(F.lit(max(vocab_size, 2)))) if vocab_size else out


def fertility(segmented: DataFrame, by: list[str]) -> DataFrame:
    """Pieces a word, pieces a character and characters a piece of (by, word, segs[, freq]) rows."""
    freq = F.col("freq") if "freq" in segmented.columns else F.lit(1)
    words, tokens = F.sum(freq).alias("words"), F.sum(F.size("segs") * freq).alias("tokens")
    chars = F.sum(F.length("word") * freq).alias("chars")
    sums = segmented.groupBy(*by).agg(words, tokens, chars)
    return sums.select(*by, "words", "tokens", "chars", ratio(F.col("tokens"), F.col("words")).alias("fertility"), ratio(F.col("tokens"), F.col("chars")).alias("tokens_per_char"), ratio(F.col("chars"), F.col("tokens")).alias("compression"))


def boundary_scores(pairs: DataFrame, by: list[str], least_words: int = 1) -> DataFrame:
    """tp, fp, fn, tn and the scores over inner positions of (by, word, gold, predicted) segmentations."""
    gold, predicted = S.boundary_set(F.col("gold")), S.boundary_set(F.col("predicted"))
    cells = pairs.select(*by, S.confusion(gold, predicted, F.col("word")).alias("c"))
    sums = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n_words"), *[F.sum(f"c.{x}").alias(x) for x in ("tp", "fp", "fn", "tn")])
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = sums.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall})
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-8))
    return out.withColumn("f1", f1).filter(F.col("n_words") >= least_words)


def alignment_score(pairs: DataFrame, by: list[str], least_chars: int = 0) -> DataFrame:
    """Percent of the gold boundaries that are predicted."""
    both = S.overlaps(S.boundary_set(F.col("gold")), S.boundary_set(F.col("predicted")))
    cells = pairs.filter(F.length("word") >= least_chars).select(*by, both.alias("o"))
    sums = cells.groupBy(*by).agg(F.sum("o.matched").alias("matched"), F.sum("o.n_gold").alias("n_gold"))
    return sums.withColumn("mas", 100.0 * F.col("matched") / at_least_one(F.col("n_gold")))


def morph_scores(rows: DataFrame, by: list[str], skip_single: bool = False, single_point: float = 0.0) -> DataFrame:
    """Macro, micro and frequency-weighted boundary scores of (by, word, gold, predicted, freq) rows.

    Rows count if the gold has several parts that spell the word. A prediction of
    one piece scores ``single_point``, or is skipped (but still counted as single).
    """
    valid = rows.filter((F.size("gold") >= 2) & (F.array_join("gold", "") == F.col("word")))
    both = S.overlaps(S.boundary_set(F.col("gold")), S.boundary_set(F.col("predicted")))
    single = F.size("predicted") <= 1
    lengths = F.aggregate("predicted", F.lit(0), lambda n, s: n + F.length(s))
    cells = valid.select(*by, "freq", single.alias("single"), both.alias("o"), (lengths != F.length("word")).alias("odd"))
    scored = ~F.col("single") if skip_single else F.lit(True)
    point = lambda own: F.when(F.col("single"), F.lit(single_point)).otherwise(own)
    recall = point(F.col("o.matched") / at_least_one(F.col("o.n_gold")))
    precision = point(F.col("o.matched") / at_least_one(F.col("o.n_predicted")))
    plain = lambda c: F.coalesce(F.sum(F.when(scored, c)), F.lit(0))
    matched = F.when(F.col("single"), 0).otherwise(F.col("o.matched"))
    predicted = F.when(F.col("single"), 0).otherwise(F.col("o.n_predicted"))
    sums = cells.groupBy(*by).agg(
        plain(F.lit(1)).alias("n_words"), plain(recall).alias("r"), plain(precision).alias("p"), plain(recall * F.col("freq")).alias("wr"), plain(precision * F.col("freq")).alias("wp"),
        plain(F.col("freq")).alias("w"), plain(matched).alias("m"), plain(F.col("o.n_gold")).alias("g"), plain(predicted).alias("q"), F.count_if("single").alias("n_single"), plain(F.col("odd").cast("int")).alias("n_odd"),
    )
    harmonic = lambda a, b: 2 * a * b / F.greatest(a + b, F.lit(TINY))
    macro_r, macro_p = ratio(F.col("r"), F.col("n_words")), ratio(F.col("p"), F.col("n_words"))
    micro_p, micro_r = ratio(F.col("m"), F.col("q")), ratio(F.col("m"), F.col("g"))
    weight = F.greatest(F.col("w"), F.lit(TINY))
    return sums.select(
        *by, "n_words", macro_r.alias("macro_recall"), macro_p.alias("macro_precision"), harmonic(macro_p, macro_r).alias("macro_f1"), micro_p.alias("micro_precision"), micro_r.alias("micro_recall"),
        harmonic(micro_p, micro_r).alias("micro_f1"), (F.col("wr") / weight).alias("weighted_recall"), (F.col("wp") / weight).alias("weighted_precision"),
        ratio(F.col("n_single"), F.col("n_words")).alias("single_rate"), ratio(F.col("n_odd"), F.col("n_words")).alias("mismatch_rate"),
    )


def inflection_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Root and suffix-count rates of (by, segs, root, is_verb, n_features) rows."""
    prefix, inside, first = S.root_is_prefix(F.col("segs"), F.col("root")), S.root_in(F.col("segs"), F.col("root")), S.first_is_root(F.col("segs"), F.col("root"))
    suffixes = F.size("segs") - 1
    cells = rows.select(*by, "is_verb", prefix.cast("int").alias("prefix"), inside.cast("int").alias("inside"), first.cast("int").alias("first"), suffixes.alias("suffixes"), (suffixes - F.col("n_features")).alias("diff"))
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name)
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_words"), mean(F.col("prefix"), "prefix_rate"), mean(F.when(F.col("is_verb"), F.col("prefix")), "prefix_rate_verb"), mean(F.when(~F.col("is_verb"), F.col("prefix")), "prefix_rate_noun"),
        mean(F.col("inside"), "root_in_rate"), mean(F.col("first"), "first_rate"), mean((F.col("diff") == 0).cast("int"), "exact_count_rate"), mean(F.col("suffixes"), "mean_suffixes"), mean(F.abs(F.col("diff")), "mean_abs_diff"),
    )


def boundary_diagnosis(pairs: DataFrame) -> DataFrame:
    """word, true_cuts, model_cuts, output, shifted: gold and predicted boundaries side by side.

    ``shifted`` says that the model's cuts are the true ones plus one, all of them.
    """
    gold, own = S.boundary_set(F.col("gold")), S.boundary_set(F.col("predicted"))
    text = lambda c: F.array_join(F.transform(c, lambda b: b.cast("string")), ",")
    shifted = (F.size(gold) > 0) & (F.transform(gold, lambda b: b + 1) == own)
    return pairs.select("word", text(gold).alias("true_cuts"), text(own).alias("model_cuts"), S.piped(S.from_boundaries(F.col("word"), own)).alias("output"), shifted.alias("shifted"))


def tokenizer_bundle(words: DataFrame, vocab: DataFrame, by: str = "name", least_chars: int = 4) -> DataFrame:
    """The standard metrics of each tokenizer, one row each.

    ``words`` has name, word, freq, segs and gold (the reference pieces) of each
    distinct word; ``vocab`` name and token. Pieces outside a tokenizer's
    vocabulary are unknown; boundaries count for words of ``least_chars`` or more.
    """
    base = fertility(words, [by]).select(by, "tokens", "fertility", "compression")
    pieces = words.select(by, F.explode("segs").alias("token"), "freq").groupBy(by, "token").agg(F.sum("freq").alias("n"))
    known = pieces.join(vocab.select(by, "token", F.lit(1).alias("known")), [by, "token"], "left")
    unknown = known.groupBy(by).agg(F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("unknown"))
    entropy = entropies(pieces, [by]).select(by, F.col("shannon").alias("subword_entropy"))
    both = S.overlaps(S.boundary_set(F.col("gold")), S.boundary_set(F.col("segs")))
    cells = words.select(by, "freq", F.when(F.length("word") >= least_chars, both).alias("o"))
    aligned = cells.groupBy(by).agg((100.0 * F.coalesce(F.sum(F.col("o.matched") * F.col("freq")), F.lit(0)) / at_least_one(F.sum(F.col("o.n_gold") * F.col("freq")))).alias("morfem_alignment"))
    sizes = vocab.groupBy(by).agg(F.count(F.lit(1)).alias("vocab_size"))
    out = base.join(unknown, by).join(entropy, by).join(aligned, by).join(sizes, by, "left")
    rate = 100.0 * F.col("unknown") / at_least_one(F.col("tokens"))
    return out.select(by, "fertility", "compression", "subword_entropy", "morfem_alignment", rate.alias("oov_rate"), (100.0 - rate).alias("vocab_coverage"), F.coalesce("vocab_size", F.lit(0)).alias("vocab_size"), F.col("tokens").alias("n_tokens"))


def exactness(rows: DataFrame, by: list[str]) -> DataFrame:
    """Percent of words whose root, number, lengths and pieces equal the gold; (by, gold, predicted)."""
    gold, own = F.col("gold"), F.col("predicted")
    lengths = lambda c: F.transform(c, lambda s: F.length(s))
    flags = {"root": F.get(gold, F.lit(0)) == F.get(own, F.lit(0)), "count": F.size(gold) == F.size(own), "length": lengths(gold) == lengths(own), "exact": gold == own}
    percent = [(100.0 * F.avg(F.coalesce(c, F.lit(False)).cast("int"))).alias(n) for n, c in flags.items()]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_words"), *percent)


def round_trips(rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of words that decode to themselves; (by, word, decoded)."""
    same = F.coalesce(F.col("word") == F.col("decoded"), F.lit(False)).cast("int")
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(same).alias("ok"))
    return sums.select(*by, "n", ratio(F.col("ok"), F.col("n")).alias("accuracy"), (100.0 * (F.col("n") - F.col("ok")) / at_least_one(F.col("n"))).alias("fail_percent"))


def failures(rows: DataFrame, by: list[str], most: int = 200) -> DataFrame:
    """The first ``most`` words a group that do not decode to themselves: a report's limit."""
    wrong = rows.filter(~F.coalesce(F.col("word") == F.col("decoded"), F.lit(False)))
    rank = F.row_number().over(W.partitionBy(*by).orderBy("word"))
    return wrong.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def validity(tokens: DataFrame, flags: DataFrame, by: list[str]) -> DataFrame:
    """Percent of tokens with each flag, over distinct tokens and by frequency.

    ``tokens`` has by and token; ``flags`` token, is_valid, is_pure, looked up once
    for each distinct token.
    """
    counts = tokens.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(flags, "token", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    total = at_least_one(F.sum("n"))
    percent = []
    for c, name in (("is_valid", "valid"), ("is_pure", "pure")):
        percent += [(100.0 * F.avg(flag(c))).alias(f"{name}_types"), (100.0 * F.sum(flag(c) * F.col("n")) / total).alias(f"{name}_tokens")]
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"), *percent)


def bits_per_char(rows: DataFrame, by: list[str]) -> DataFrame:
    """Bits a character, mean nats a token and perplexity of (by, nll, n_tokens, chars) rows."""
    sums = rows.groupBy(*by).agg(F.sum("nll").alias("nll"), F.sum("n_tokens").alias("n_tokens"), F.sum("chars").alias("chars"))
    mean = F.col("nll") / at_least_one(F.col("n_tokens"))
    return sums.select(*by, "n_tokens", "chars", (F.col("nll") / F.lit(0.6931471805599453) / at_least_one(F.col("chars"))).alias("bpc"), mean.alias("nll_per_token"), F.exp(mean).alias("perplexity"))


def classification(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, micro and macro F1 of one label column against another, in one row."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)
    by_truth = cells.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("gold"), F.sum(hit).alias("tp"))
    by_guess = cells.groupBy(F.col("g").alias("label")).agg(F.sum("n").alias("guessed"))
    both = by_truth.join(by_guess, "label", "full").na.fill(0)
    f1 = 2.0 * F.col("tp") / at_least_one(F.col("gold") + F.col("guessed"))
    return both.agg(
        F.sum("gold").alias("n"), (F.sum("tp") / at_least_one(F.sum("gold"))).alias("accuracy"), F.avg(f1).alias("macro_f1"),
        (2.0 * F.sum("tp") / at_least_one(F.sum("gold") + F.sum("guessed"))).alias("micro_f1"),
    )


def timings(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(value).alias("runs"), F.median(value).alias("median"), F.stddev_samp(value).alias("stdev"))


def group_sizes(rows: DataFrame, by: str) -> DataFrame:
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.min("n").alias("smallest"), F.avg("n").alias("mean"), F.max("n").alias("largest"))


def equal_parameter_dim(vocab: Column, target: int, layers: int, length: int, heads: int, low: int = 128, high: int = 1024) -> Column:
    """Model width at which a vocabulary's parameters reach ``target``, in whole heads."""
    a, b = 12.0 * layers, (vocab + length).cast("double")
    root = (-b + F.sqrt(b * b + 4 * a * target)) / (2 * a)
    whole = F.greatest(F.rint(root / heads) * heads, F.lit(heads))
    return F.greatest(F.lit(low), F.least(F.lit(high), whole)).cast("int")


def parameters(vocab: Column, dim: Column, layers: int, length: int) -> Column:
    return (vocab * dim + 12 * layers * dim * dim + length * dim).cast("long")
