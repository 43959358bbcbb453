from datetime import datetime, timedelta

from skywait.config import Config

DAY0 = datetime(2024, 1, 1)
OBSERVED = "aoi_id string, datatake_id string, config_hash string, observed_at timestamp, catalog_cloud_cover double, usable boolean, complete boolean"


def at(days, hours=0):
    return DAY0 + timedelta(days=days, hours=hours)


def config(**kw):
    from datetime import date

    return Config(**({"start": date(2024, 1, 1), "end": date(2024, 3, 31), "aois": ("alpha",), "horizon_days": 60} | kw))


def golden(spark, cfg):
    rows = [("alpha", f"t{d}", cfg.config_hash, at(d), float(c), u, True) for d, c, u in zip((0, 2, 5, 10, 40, 50), (10, 15, 20, 25, 30, 5), (True, False) * 3, strict=True)]
    rows += [("alpha", "incomplete", cfg.config_hash, at(20), 0.0, True, False), ("alpha", "historical", "other", at(1), 0.0, True, True)]
    return spark.createDataFrame(rows, OBSERVED)


def two_entities(spark, cfg):
    h = cfg.config_hash
    alpha = [(0, 6, 10), (2, 12, 15), (5, 18, 20), (10, 3, 25), (40, 9, 30), (50, 15, 5)]
    rows = [("alpha", f"take-{k}", h, at(d, x), float(c), k % 2 == 0, True) for k, (d, x, c) in enumerate(alpha)]
    rows += [
        ("alpha", "alpha-incomplete", h, at(20), 0.0, True, False), ("beta", "beta-unusable", h, at(1, 7), None, False, True),
        ("beta", "beta-incomplete", h, at(8), 0.0, True, False), ("alpha", "other", "other", at(1), 0.0, True, True),
    ]
    return spark.createDataFrame(rows, OBSERVED)
