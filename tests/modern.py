"""The well-known graph of six vertices."""

from skein.graph import PropertyGraph


def modern(spark) -> PropertyGraph:
    person = spark.createDataFrame([(1, "marko", 29), (2, "vadas", 27), (4, "josh", 32), (6, "peter", 35)], "id long, name string, age int")
    software = spark.createDataFrame([(3, "lop", "java"), (5, "ripple", "java")], "id long, name string, lang string")
    knows = spark.createDataFrame([(7, 1, 2, 0.5), (8, 1, 4, 1.0)], "id long, src long, dst long, weight double")
    created = spark.createDataFrame([(9, 1, 3, 0.4), (10, 4, 5, 1.0), (11, 4, 3, 0.4), (12, 6, 3, 0.2)], "id long, src long, dst long, weight double")
    ends = {"knows": (("person",), ("person",)), "created": (("person",), ("software",))}
    return PropertyGraph(spark, {"person": person, "software": software}, {"knows": knows, "created": created}, ends)
