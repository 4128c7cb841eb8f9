"""Ids found in attribute text without taking it apart, and attribute texts made once for a transcript."""

import random

from pyspark.sql import functions as F

from strandframe.functions import attributes as A
from strandframe.sources import annotation


def test_value_of_one_key_is_that_of_the_map(spark):
    rng = random.Random(4)
    bits = ['gene_id "g";', ' gene_id "h" ;', 'gene_id  "i";', '"gene_id "j";', "gene_id k;", 'gene_id "";', 'gene_id " l "', 'gene_id "a;b";', 'gene_id "a "b";', 'xgene_id "m";', 'gene_ids "n";',
            ' tag "gene_id";', ";", " ", '"', "é", 'zz "é gene_id "o"";', 'gene_id "é"', 'gene_id "p" x;', 'gene_id "q"";']
    texts = [None, "", *bits, *["".join(rng.choices(bits, k=rng.randint(1, 5))) for _ in range(1500)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", A.parsed_value(F.col("t"), "gene_id").alias("got"), F.try_element_at(A.parse_attributes(F.col("t")), F.lit("gene_id")).alias("want")).collect()
    assert [r for r in rows if r.got != r.want] == []
    assert len({r.got for r in rows}) > 8


def test_maps_are_made_only_where_used(spark):
    """Ids took a map for every line, and a line's text two more."""
    lines = spark.createDataFrame([('s\tx\texon\t1\t9\t.\t+\t.\ttranscript_id "t"; gene_id "g";',)], "value string")
    ids = annotation.with_ids(annotation.features(lines))
    assert ids.select("attrs", "tid", "gene").first() == ({"transcript_id": "t", "gene_id": "g"}, "t", "g")
    text = ids.select("tid", "gene")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS attrs" not in text and "Generate explode(array(map_from_entries" not in text
    out = annotation.transcript_lines(annotation.assemble(ids))
    assert sorted(out.select("rank", "value").collect())[1] == (1, 's\tx\texon\t1\t9\t.\t+\t.\ttranscript_id "t"; gene_id "g";')
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" in plan[plan.index("Generate posexplode"):] and "array_join" not in plan[: plan.index("Generate posexplode")]


def test_lines_of_fewer_fields_are_left_out(spark):
    """Conditions on ids may be asked before the number of fields."""
    lines = spark.createDataFrame([('s\tx\texon\t1\t9\t.\t+\t.\ttranscript_id "t"; gene_id "g";',), ('x\texon\t1\t9\t+\ttranscript_id "u";',), ("",), (None,)], "value string")
    got = annotation.assemble(annotation.with_ids(annotation.features(lines)))
    assert [r.tid for r in got.collect()] == ["t"]
