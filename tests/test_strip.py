from pyspark.sql import functions as F

from veilspark.functions.text import strip


def test_strip_takes_the_white_space_of_the_pattern(spark):
    rows = spark.range(1, 0x3100).select(F.concat(F.chr("id"), F.lit("a"), F.chr("id")).alias("c"))
    rows = rows.unionByName(spark.createDataFrame([("",), ("  \n",), ("\x85 a b \x1c　",), (None,), ("a\n",)], "c string"))
    points = rows.where(F.length("c") > 0).unionByName(rows.where("c IS NULL OR c = ''"))
    assert points.where(~strip(F.col("c")).eqNullSafe(F.regexp_replace("c", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))).count() == 0
