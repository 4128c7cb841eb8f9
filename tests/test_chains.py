"""Chain functions against worked examples and against sets of positions."""

import random

from pyspark.sql import functions as F

from strandframe.functions import chains as C
from strandframe.functions import sequences as Q
from strandframe.operators import transfer


def df_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def chain(rng, top=60):
    cuts = sorted(rng.sample(range(1, top), 2 * rng.randint(1, 4)))
    out = []
    for s, e in zip(cuts[::2], cuts[1::2]):
        if not out or s > out[-1][1] + 1:
            out.append((s, e))
    return out


def bases(c):
    return [p for s, e in c for p in range(s, e + 1)]


def tup(rows):
    return [tuple(x) for x in rows] if rows is not None else None


def test_worked_examples(spark):
    d = df_of(spark, [([(1, 5), (9, 12)], [(1, 5), (5, 9), (10, 12)], [(1, 10)], [(3, 5)], [(2, 10)])],
              "c array<struct<s:bigint,e:bigint>>, m array<struct<s:bigint,e:bigint>>, a array<struct<s:bigint,e:bigint>>, b array<struct<s:bigint,e:bigint>>, f array<struct<s:bigint,e:bigint>>")
    c, plus, minus = F.col("c"), F.lit("+"), F.lit("-")
    r = d.select(
        C.introns(c).alias("boundary"), C.introns(c, "base").alias("base"), C.cigar(c).alias("cigar"), C.as_text(c).alias("text"),
        C.to_genome(c, plus, F.lit(5)).alias("p"), C.to_genome(c, minus, F.lit(5)).alias("n"), C.to_genome_edge(c, plus, F.lit(5)).alias("edge"),
        C.merge(F.col("m")).alias("m0"), C.merge(F.col("m"), 1).alias("m1"), C.segments(F.col("a"), F.col("b")).alias("seg"),
        C.frame_segments(F.col("a"), F.col("f"), plus).alias("fr"), C.first_positions(c, 3).alias("f3"), C.first_positions(c, 5, True).alias("r5"),
        C.first_positions(c, 10).alias("short"), C.phases(F.array(C.interval(F.lit(1), F.lit(4)), C.interval(F.lit(10), F.lit(14))), plus).alias("ph"),
        C.from_text(F.lit("1-5,9-12")).alias("back"), C.overlaps(F.lit(1), F.lit(5), F.lit(5), F.lit(9)).alias("closed"),
        C.overlaps(F.lit(1), F.lit(5), F.lit(5), F.lit(9), 2).alias("open"), C.split(F.col("a")[0], F.col("b")[0]).alias("sp"),
    ).first()
    assert tup(r["boundary"]) == [(5, 9)] and tup(r["base"]) == [(6, 8)]
    assert r["cigar"] == "5M3N4M" and r["text"] == "1-5,9-12" and tup(r["back"]) == [(1, 5), (9, 12)]
    assert (r["p"], r["n"], r["edge"]) == (9, 4, 6)
    assert tup(r["m0"]) == [(1, 9), (10, 12)] and tup(r["m1"]) == [(1, 12)]
    assert tup(r["seg"]) == [(1, 2, -1), (3, 5, 0), (6, 10, -1)]
    assert tup(r["fr"]) == [(1, 1, -1), (2, 10, -100)]
    assert r["f3"] == [1, 2, 3] and r["r5"] == [12, 11, 10, 9, 5] and r["short"] is None
    assert [x["phase"] for x in r["ph"]] == [0, 2]
    assert r["closed"] and not r["open"]
    assert (tuple(r["sp"]["left"]), tuple(r["sp"]["overlap"]), tuple(r["sp"]["right"])) == ((1, 2), (3, 5), (6, 10))


def _longest_run(own, other):
    """Runs of shared pieces that continue in both chains, by walking pieces."""
    runs, ready, last = [], False, None
    for s, e in own:
        hits = [(max(s, a), min(e, b), s == a, e == b, j) for j, (a, b) in enumerate(other) if max(s, a) <= min(e, b)]
        if not hits:
            ready = False
        for hs, he, opens, closes, j in hits:
            if ready and opens and last == j - 1:
                runs[-1].append((hs, he))
            else:
                runs.append([(hs, he)])
            ready, last = closes, j
    return max(runs, key=lambda r: sum(b - a + 1 for a, b in r), default=[])


def test_against_positions(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        lo, hi = sorted(rng.sample(range(1, 60), 2))
        rows.append((i, chain(rng), chain(rng), rng.choice("+-"), lo, hi))
    d = df_of(spark, rows, "id int, a array<struct<s:bigint,e:bigint>>, b array<struct<s:bigint,e:bigint>>, st string, lo bigint, hi bigint")
    a, b, st = F.col("a"), F.col("b"), F.col("st")
    got = d.select(
        "id", C.chain_length(a).alias("n"), C.shared_bases(a, b).alias("sh"), C.chain_intersection(a, b).alias("inter"), C.union(a, b).alias("un"),
        C.clip(a, F.col("lo"), F.col("hi")).alias("clip"), C.clip(a, F.col("lo"), F.col("hi"), 2).alias("clip2"), C.clip_to_shared(a, b).alias("strict"),
        C.longest_compatible(a, b).alias("lc"), C.phases(a, st).alias("ph"), C.compare_metrics(a, b, st).alias("m"),
        C.to_genome(a, st, F.lit(7)).alias("g"), C.phase_at(a, st, F.col("lo")).alias("pa"),
    ).collect()
    for r, (i, ca, cb, s, lo, hi) in zip(sorted(got, key=lambda r: r["id"]), rows):
        A, B = set(bases(ca)), set(bases(cb))
        assert r["n"] == len(A) and r["sh"] == len(A & B)
        assert set(bases(tup(r["inter"]))) == A & B and set(bases(tup(r["un"]))) == A | B
        assert set(bases(tup(r["clip"]))) == {p for p in A if lo <= p <= hi}
        assert tup(r["clip2"]) == [x for x in tup(r["clip"]) if x[1] > x[0]]
        both = sorted(A & B)
        assert set(bases(tup(r["strict"]))) == ({p for p in A if both[0] <= p <= both[-1]} if both else set())
        assert sum(e - s0 + 1 for s0, e in tup(r["lc"])) == sum(e - s0 + 1 for s0, e in _longest_run(ca, cb))
        order = bases(ca) if s == "+" else bases(ca)[::-1]
        first = {(x["e"] if s == "-" else x["s"]): x["phase"] for x in r["ph"]}
        assert all((3 - order.index(p) % 3) % 3 == ph for p, ph in first.items())
        assert r["g"] == (order[7] if len(order) > 7 else order[-1])
        assert r["pa"] == ((3 - order.index(lo) % 3) % 3 if lo in A else None)
        q = t = inf = 0
        for p in (sorted(A | B) if s == "+" else sorted(A | B, reverse=True)):
            if p in A and p in B:
                inf += q % 3 == t % 3
            elif p in A:
                q += 1
            else:
                t += 1
        m = r["m"]
        assert (m["extra"], m["missing"], m["matched"], m["inframe"]) == (len(A - B), len(B - A), len(A & B), inf)
        assert m["ilpi"] == 100 * inf // len(A | B) and m["lpi"] == 100 * len(A) // len(A | B)


def test_trim_to_codons(spark):
    """The fitted chain starts and ends on whole template codons inside the cut."""
    rng = random.Random(9)
    rows = []
    while len(rows) < 200:
        own, tmpl = chain(rng), chain(rng)
        if len(bases(tmpl)) % 3 == 0 and len(set(bases(own)) & set(bases(tmpl))) >= 6:
            rows.append((len(rows), own, tmpl, rng.choice("+-")))
    d = df_of(spark, rows, "id int, a array<struct<s:bigint,e:bigint>>, b array<struct<s:bigint,e:bigint>>, st string")
    cut = C.clip_to_shared(F.col("a"), F.col("b"))
    got = d.withColumn("cut", cut).select("id", transfer.trim_to_codons(F.col("a"), F.col("cut"), F.col("b"), F.col("st")).alias("fit")).collect()
    for r, (i, own, tmpl, s) in zip(sorted(got, key=lambda r: r["id"]), rows):
        shared = [p for p in bases(own) if p in set(bases(tmpl))]
        inside = [p for p in bases(own) if shared[0] <= p <= shared[-1]]
        order, frame = (inside, bases(tmpl)) if s == "+" else (inside[::-1], bases(tmpl)[::-1])
        skip, drop = -frame.index(order[0]) % 3, (frame.index(order[-1]) + 1) % 3
        assert sorted(bases(tup(r["fit"]))) == sorted(order[skip : len(order) - drop])


def test_perfect_fit_scores_zero(spark):
    d = df_of(spark, [([(1, 9), (20, 28)], [(1, 9), (20, 28)], [(4, 9), (20, 28)])],
              "a array<struct<s:bigint,e:bigint>>, b array<struct<s:bigint,e:bigint>>, c array<struct<s:bigint,e:bigint>>")
    r = d.select(transfer.difference(F.col("a"), F.col("b"), F.lit("+")).alias("x"), transfer.difference(F.col("a"), F.col("c"), F.lit("-")).alias("y")).first()
    assert r["x"]["score"] == 0 and r["x"]["matched"] == 18
    assert (r["y"]["missing_start"], r["y"]["missing_end"], r["y"]["extra"], r["y"]["score"]) == (0, 1, 3, 13)


def test_sequences(spark):
    seq = "CCATGAAATAGATGCCCTGAATGTTTTAA"
    d = spark.createDataFrame([(seq,), ("NNNATGRAYYTA",), ("",)], "s string")
    r = d.select(Q.translate(F.col("s")).alias("aa"), Q.reverse_complement(F.col("s")).alias("rc"), Q.longest_orfs(F.col("s")).alias("o"), Q.ambiguity(F.col("s")).alias("amb")).collect()
    assert tup(r[0]["o"]) == [(2, 10), (11, 19), (20, 28)] and r[1]["aa"] == "XMBL" and r[2]["aa"] == "" and r[2]["o"] == []
    assert r[0]["rc"] == seq[::-1].translate(str.maketrans("ACGT", "TGCA")) and r[2]["amb"] is None
    table = Q.codon_table()
    assert table["GCN"] == "A" and table["TAR"] == "." and table["YTR"] == "L" and table["MGR"] == "R" and "NNA" not in table


def test_refit_with_sequence(spark):
    #         1234567890123456789012345678901
    genome = "CATGAAACCCATGAAATTTGGGTAACCCCCC"
    flipped = genome[::-1].translate(str.maketrans("ACGT", "TGCA"))
    own, n = [(1, len(genome))], len(genome)
    cases = {"up": (14, 19, 14), "same": (11, 19, 11), "limit": (11, 19, 2)}
    rows = [(k, own, [(lo, hi)], "+", genome, 1, t) for k, (lo, hi, t) in cases.items()]
    rows += [(k + "-", own, [(n + 1 - hi, n + 1 - lo)], "-", flipped, 1, n + 1 - t) for k, (lo, hi, t) in cases.items()]
    iv = "array<struct<s:bigint,e:bigint>>"
    d = spark.createDataFrame(rows, f"k string, own {iv}, cut {iv}, st string, g string, o bigint, t bigint")
    got = {r["k"]: tup(r["refit"]) for r in transfer.refit_with_sequence(d, "own", "cut", "st", "g", "o", "t").collect()}
    # no M in the cut: it grows up to the furthest M before a stop and down to the stop;
    # the template's own start ends the search
    assert got["up"] == got["same"] == [(2, 25)] and got["limit"] == [(11, 25)]
    assert got["up-"] == got["same-"] == [(n - 24, n - 1)] and got["limit-"] == [(n - 24, n - 10)]
