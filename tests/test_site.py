"""Prompts take all their variables, and defaults where something is missing."""

from sitebrief.plans.site_plans import TEMPLATES, section_prompts


def test_prompts_with_and_without_context(spark):
    companies = spark.createDataFrame([("a", "Acme {content}", "https://a", None), ("b", None, None, "Tools")],
                                      "company_id string, company_name string, website_url string, industry string")
    fields = ["content", "entities", "people_entities", "org_entities", "tech_entities", "team_content", "careers_content"]
    context = spark.createDataFrame([("a", *[f"<{f}>" for f in fields])], "company_id string, " + ", ".join(f"{f} string" for f in fields))
    previous = spark.createDataFrame([("a", "key_insights", "before")], "company_id string, section string, previous_analysis string")
    reports = spark.createDataFrame([("a", '{"x":1}'), ("b", None)], "company_id string, full_analysis string")
    got = {(r["company_id"], r["section"]): r["prompt"] for r in
           section_prompts(companies, context, previous, reports, TEMPLATES, ["key_insights", "executive_summary"]).collect()}
    assert len(got) == 4
    text = got["a", "key_insights"]
    assert "Acme {content} (https://a, Unknown)" in text and "before" in text and '{"x":1}' in text
    assert all(f"<{f}>" in text for f in fields) and "before" not in got["a", "executive_summary"]
    assert "of Unknown Company (, Tools)." in got["b", "executive_summary"] and "{" not in got["b", "executive_summary"]
