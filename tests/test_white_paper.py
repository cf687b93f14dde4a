"""Cells of the white paper: populated, verified absent, or left to the analyst."""

from __future__ import annotations

from tessera.plans import corpus


def cells(spark, **more):
    frame = spark.createDataFrame
    products = frame(
        [
            ("NDA000001", "Zinc Sulfate", "TABLET;ORAL", "Zincor", "5 mg", "Maker", "Yes", "No"), ("NDA000001", "Zinc Sulfate", "CAPSULE;ORAL", "Zincor", "10 mg", " Maker ", "No", ""),
            ("NDA000002", "Iron", "TABLET;ORAL", "", None, "Other", None, "RS"), ("NDA000003", "", "", None, "", "", "", ""), (None, "Lost", "x", "", "", "", "", ""),
        ],
        "number string, ingredient string, df_route string, trade_name string, strength string, applicant string, rld string, rs string",
    )
    sections = [("NDA000001", code, f"text {code}") for code in corpus.PLR[:4]] + [("NDA000001", "42228-7", "Before. There is a pregnancy exposure registry here. After."), ("NDA000001", "34090-1", "short"), ("NDA000001", "34090-1", "the longer one")]
    sections += [("NDA000002", code, "x") for code in corpus.PLLR] + [("NDA000002", "42227-9", "CII")]
    out = corpus.white_paper(
        products, frame([("NDA000001", "p2"), ("NDA000001", "p1"), ("NDA000009", "p9")], "number string, patent_no string"), frame([("NDA000001", "NCE")], "number string, code string"), frame([("NDA000002",), ("NDA000002",)], "number string"),
        frame(sections, "number string, code string, text string"), **{k: frame(*v) for k, v in more.items()},
    )
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("Union") == 0
    rows = out.collect()
    assert len(rows) == 4 * len(corpus.CELLS)
    return {(r.number, r.cell_id): (r.status, r.value, r.evidence) for r in rows}


def test_own_sources(spark):
    c = cells(spark)
    a, b, e = "NDA000001", "NDA000002", "NDA000003"
    assert c[a, "product_name"][:2] == ("populated", "Zinc Sulfate") and c[a, "dosage_form"][1] == "CAPSULE; TABLET" and c[a, "strengths"][1] == "10 mg; 5 mg" and c[a, "nda_holder"][1] == "Maker"
    assert c[e, "product_name"][:2] == ("analyst_input_required", None) and c[None, "product_name"][1] == "Lost" and c[a, "nda_number"][1] == a and c[None, "nda_number"][0] == "analyst_input_required"
    assert [c[x, "rld"][0] for x in (a, b)] == ["populated", "verified_absent"] and [c[x, "rs"][0] for x in (a, b)] == ["verified_absent", "populated"]
    assert [c[x, "be_guidance_available"][:2] for x in (a, b)] == [("verified_absent", None), ("populated", "Yes")]
    assert c[a, "plr_format"][1] == "PLR format" and c[b, "plr_format"][0] == "analyst_input_required" and c[b, "pllr_format"][1] == "PLLR format" and c[a, "pllr_format"][1] is None
    assert c[a, "pregnancy_registry"][1].strip() == "There is a pregnancy exposure registry here." and c[a, "epc"][1] == "the longer one" and c[b, "dea_classification"][1] == "CII"
    assert c[a, "patents"] == ("analyst_input_required", None, ["p1", "p2"]) and c[a, "eftf"][2] == ["NCE"] and c[b, "eftf"][2] is None
    # sources that weren't in the snapshot say nothing
    assert {c[x, cell] for x in (a, b) for cell in ("drug_shortage", "rems", "labeling_images", "requirements", "prepared_by") for _ in [0] if c[x, cell][2] is None} == {("analyst_input_required", None, None)}


def test_other_sources(spark):
    a, b, e = "NDA000001", "NDA000002", "NDA000003"
    more = {
        "shortages": ([(a, "Resolved"), (b, "Current"), (b, "Resolved")], "number string, status string"),
        "programs": ([("Zinc Sulfate program", "NDA #000001"), ("IRON oxide", "NDA000777"), ("Unrelated", None)], "name string, number string"),
        "media": ([(a, 2), (a, 1), (a, 2)], "number string, page int"),
        "requirements": ([(b, "Two studies"), (b, " "), (a, None)], "number string, text string"),
    }
    c = cells(spark, **more)
    assert c[a, "drug_shortage"][1].startswith("Resolved — historical") and c[b, "drug_shortage"][1] == "Yes — Current; Resolved" and c[e, "drug_shortage"][0] == "verified_absent"
    assert c[a, "rems"] == ("populated", "Yes", ["Zinc Sulfate program"]) and c[b, "rems"] == ("analyst_input_required", None, ["IRON oxide"])
    assert c[e, "rems"][0] == "analyst_input_required" and c[None, "rems"][0] == "verified_absent"  # no name to look for; a name that no program has
    assert c[a, "labeling_images"] == ("populated", "2 label pages", ["page 1", "page 2"]) and c[b, "labeling_images"][0] == "analyst_input_required"
    assert c[b, "requirements"][:2] == ("populated", "Two studies") and c[a, "requirements"][0] == "analyst_input_required"
    assert cells(spark, programs=([], "name string, number string"))[a, "rems"][0] == "analyst_input_required"  # an empty index proves nothing
