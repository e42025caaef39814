"""Record resolution, contract assembly and query templates."""

from pyspark.sql import functions as F

from leadlake.operators import resolution as V


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_sector_and_place(spark):
    sector = lambda text, c=0.5: one(spark, V.inferred_sector(F.struct(F.lit("Given").alias("sector"), F.lit(c).alias("confidence")), F.lit(text)))
    assert sector("an AI lab") == "Artificial Intelligence & ML" and sector("maintain") == "Unknown" and sector("x", 0.7) == "Given" and sector("our store sells gpt") == "Retail, Supermarkets & E-Commerce"
    place = lambda u, text: one(spark, V.inferred_location(F.lit(u), F.lit(text)))
    assert place("https://x.de", "in Austin") == "Germany" and place("https://x.com", "in Austin") == "Austin, TX, USA" and place("https://x.com", "") == "Unknown"


def test_record(spark):
    data = F.create_map(F.lit("industry"), F.lit("General"), F.lit("contact_emails"), F.lit("a@x.io, b@x.io"))
    place = F.struct(F.lit("Berlin, Germany").alias("formatted"), F.lit("Germany").alias("country"))
    r = one(spark, V.resolve_record(data, place, F.lit("a team of 35 people"), F.lit(None).cast("string"), F.array(F.lit("b@x.io"), F.lit("c@x.io")), F.lit("Software")))
    assert tuple(r) == ("Berlin, Germany", "Germany", "35", "Small (11-50)", "Software", ["a@x.io", "b@x.io", "c@x.io"])
    nowhere = F.struct(F.lit(None).cast("string").alias("formatted"), F.lit(None).cast("string").alias("country"))
    r = one(spark, V.resolve_record(F.create_map(F.lit("company_size"), F.lit("1000+")), nowhere, F.lit(""), F.lit("7"), F.array().cast("array<string>"), F.lit("Software")))
    assert (r.country, r.company_size, r.company_tier) == ("United States", "1000+", "Enterprise (1000+)")


def test_recrawl(spark):
    f = lambda m, c: one(spark, V.recrawl_paths(F.array(*map(F.lit, m)), F.array(*map(F.lit, c)).cast("array<string>") if c else F.array().cast("array<string>")))
    assert f(["location_region", "company_size_tier"], ["/contact"]) == ["/locations", "/about", "/careers"]
    assert f(["x"], []) == ["/about", "/contact"]


def test_assembled_contract(spark):
    s = spark.createDataFrame([(1, "d1", "Acme", "acme.io", "We build useful tools for people", "Software"), (2, "d2", "Globex", "globex.com", "short", "")], "id int, document_id string, company_name string, domain string, description string, industry string")
    d = spark.createDataFrame([("d1", 200, "vault/a/b"), ("d2", 0, None)], "id string, word_count int, raw_path string")
    e = spark.createDataFrame([(1, "location_region", "Rome", "VERIFIED", 1), (1, "location_region", "Berlin", "VERIFIED", 2)], "session_id int, field string, value string, status string, updated_at int")
    p = spark.createDataFrame([(1, "HIGH_CONFIDENCE")], "session_id int, verification_status string")
    got = {r.id: r for r in V.evaluate(V.assemble(s, d, e, p), "vault").collect()}
    assert got[1].contract.state == "VERIFIED" and got[1].evidence["location_region"].value == "Berlin" and got[1].contract.completeness == round(60 + 40 / 70 * 40, 1)
    assert got[2].contract.state == "NEEDS_REVIEW" and got[2].contract.core_passed == 2


def test_profile_queries(spark):
    c = spark.createDataFrame([("Acme Robotics Inc", "www.acme.io")], "name string, domain string")
    q = [r.query for r in V.profile_queries(c, 1).orderBy("place").collect()]
    assert len(q) == 7 and q[0] == "Acme Robotics CEO linkedin profile" and q[2] == "acme.io CEO founder linkedin profile" and V.profile_queries(c, 2).count() == 8
