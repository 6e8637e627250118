from pyspark.sql import functions as F

from runlens.functions import names
from runlens.operators import curate

# scenario: raw truth, raw estimator, the same with the wider suffixes, split parts 2, 3
TABLE = {
    "no_rt": (None, None, None, "", ""),
    "rt_2_x_rt_2": ("rt_2", None, None, "rt", "_2"),
    "no_rt_x_all_yrs": ("no_rt", None, None, "all_yrs", ""),
    "flat_x_young_rt_2": ("flat", "young", "young", "young_rt", "_2"),
    "flat_x_flat_34_all_yrs": ("flat", "flat_34", "flat_34", "flat", "_34_all_yrs"),
    "flat_x_flat_rt_34": ("flat", None, "flat", "flat_rt", "_34"),
    "young_x_no_rt": ("young", None, None, "no_rt", ""),
    "no_rt_x_flat_rt_17": ("no_rt", None, None, "flat_rt", "_17"),
    "no_rt_x_flat_all_yrs": ("no_rt", "flat", "flat", "flat_all_yrs", ""),
}
SPECIAL = {
    "no_rt": ("no_rt", "reference"),
    "rt_2_x_rt_2": ("rt_2_x_rt_2", "reference"),
    "no_rt_x_all_yrs": ("no_rt_x_all_yrs", "all years"),
    "flat_x_young_rt_2": ("flat", "young"),
    "young_x_no_rt": ("young", "reference"),
    "flat_x_flat_rt_34": ("flat", "reference"),
}


def frame(spark, names_):
    return spark.createDataFrame([(n,) for n in names_], "scenario string")


def test_truth_table(spark):
    s = F.col("scenario")
    _, em3, ex3 = names.raw_parts(s)
    got = frame(spark, TABLE).select(
        s, names.raw_truth(s), names.raw_estimator(s),
        names.raw_estimator(s, names.DESIGN_SUFFIXES), em3, ex3,
    )
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == TABLE


def test_special_cases(spark):
    got = curate.parse_scenario(frame(spark, SPECIAL)).collect()
    assert {r.scenario: (r.om_name, r.em_name) for r in got} == SPECIAL
    wide = curate.parse_scenario(frame(spark, ["flat_x_flat_rt_34"]), names.DESIGN_SUFFIXES).first()
    assert (wide.om_name, wide.em_name) == ("flat", "flat")


def test_parts_clean_up(spark):
    got = curate.parse_scenario_parts(frame(spark, ["flat_x_flat_rt_34", "no_rt", "young_x_no_rt"]))
    assert {r.scenario: (r.om_name, r.em_name, r.design) for r in got.collect()} == {
        "flat_x_flat_rt_34": ("flat", "flat", "rt_34"),
        "no_rt": ("no_rt", None, None),
        "young_x_no_rt": ("young", "no_rt", ""),
    }


def test_ordinals_and_groups(spark):
    s = frame(spark, ["young", "nowhere"])
    got = s.select(names.level_ordinal(F.col("scenario"), names.TRUTH_LEVELS)).collect()
    assert [r[0] for r in got] == [2, None]
    dim = curate.scenario_dim(spark).collect()
    assert len(dim) == 4 + 3 + 4 * 16 and len({r.scenario for r in dim}) == len(dim)
    assert [r.ordinal for r in dim] == list(range(1, len(dim) + 1))


def test_design_classes(spark):
    rows = ["no_rt", "rt_2_x_no_rt", "rep_3_x_all_yrs", "rt_2_x_rt_2_high"]
    base = curate.classify_design(frame(spark, rows)).collect()
    assert [(r.em_class, r.om_class) for r in base] == [
        ("no event", "no event"),
        ("no event", "two-year event"),
        ("every-year event", "repeated event"),
        ("two-year event", "two-year event"),
    ]
    high = curate.classify_design(frame(spark, rows[3:]), "high").first()
    assert (high.em_class, high.om_class) == ("two-year high event", "two-year high event")
