"""Texts without a shingle of a template are passed over before windows are made, and no notice is lost by it."""

from notewell.llm import license_scan


def test_only_texts_with_a_templates_shingle_get_windows(spark):
    prose = " ".join(f"word{k % 97} other{k % 89}" for k in range(400))
    notice = license_scan.TEMPLATES["BSD"][0]
    rows = [(1, prose), (2, f"{prose} {notice}"), (3, f"{prose} All rights reserved. {prose}"), (4, "under the terms of the sale"), (5, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = license_scan.scan_licenses(docs)
    assert "exists(" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["doc_id"], r["license"]) for r in found.collect()) == [(2, "BSD"), (3, "All-rights-reserved")]
