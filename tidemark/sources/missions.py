"""Missions: orbits, cycles that products lack, tagged periods, tandem phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Earth's rotation and ground speed in km/s, inclination in degrees, height in metres, last pass number.
_JASON = {"earth_speed": 0.46, "ground_speed": 5.8, "inclination": 66.16, "altitude": 1337500.0, "passes": 254}
SPECS = {m: _JASON for m in ("tx", "j1", "j2", "j3", "s6A", "s6Ah")} | {
    "s3": {"earth_speed": 0.46, "ground_speed": 5.8, "inclination": 98.65, "altitude": 814500.0, "passes": 385},
    "sw": {"earth_speed": 0.46, "ground_speed": 7.372, "inclination": 77.6, "altitude": 857244.0, "passes": 584},
    "sa": {"earth_speed": 0.46, "ground_speed": 7.47, "inclination": 98.538, "altitude": 781000.0, "passes": 1002},
}
#: Passes that a mission's product does not have.
MISSING_PASSES = {"s3": (155, 156)}

# Cycles that the products do not provide.
BAD_CYCLES = {
    "tx": (1, 2, 20, 31, 41, 55, 65, 79, 91, 97, 103, 114, 118, 126, 138, 150, 162, 174, 180, 186, 197, 209, 216, 224, 234, 243, 256, 266, 278, 289, 299, 307, 361, 398, 416, 417, 418, 419, 420, 431, 432),
    "j1": (178, 243, 260, 261),
    "j2": (304, 507, 508),
    "j3": (112, 213),
    "s3": (1, 2, 3, 4, 5),
    "s6A": (1, 2, 3, 4, 38),
    "s6Ah": (1, 2, 3, 4, 38),
    "sw": (128, 132, 174, 226, 227),
    "sa": tuple(range(36)),
}

# Tandem phases as first mission, second mission, first and last cycle of the first, shift, cycle left out.
TANDEM = {"txj1": ("tx", "j1", 344, 364, 343, 361), "j1j2": ("j1", "j2", 240, 259, 239, 243), "j2j3": ("j2", "j3", 281, 303, 280, None), "j3s6A": ("j3", "s6A", 180, 227, 175, None)}

# Tagged periods as first and last cycle.
PERIODS = {
    "tx": {"sa": (48, 100), "sb": (280, 364), "sb2": (280, 316), "y1": (1, 11), "y2": (12, 47), "y3": (48, 84), "y4": (85, 121), "y5": (122, 158), "y6": (159, 195), "y7": (196, 232), "y8": (235, 268), "y9": (269, 305), "y10": (306, 341), "all": (48, 364), "sa_all": (48, 235), "sb_all": (236, 364)},
    "j1": {"y1": (1, 36), "y2": (37, 73), "y3": (74, 110), "y4": (111, 146), "y5": (147, 183), "y6": (184, 220), "y7": (221, 257), "all": (1, 259)},
    "j2": {"cnes": (1, 36), "y1": (1, 18), "y2": (19, 55), "y3": (56, 91), "y4": (92, 128), "y5": (129, 165), "y6": (166, 202), "y7": (203, 239), "y8": (240, 276), "y9": (277, 303), "all": (1, 303)},
    "j3": {"cls": (17, 54), "rtrk": (22, 54), "y1": (1, 32), "y2": (33, 69), "y3": (70, 105), "y4": (107, 143), "y5": (144, 179), "y5s": (156, 170), "y45ws": (135, 170), "y6": (180, 215), "y456": (107, 215), "all": (1, 227)},
    "s3": {"y1": (1, 11), "y2": (12, 26), "y3": (27, 40), "y4": (41, 53)},
    "s6A": {"sa": (5, 30), "sb": (32, 57), "y1": (5, 41), "all": (5, 62)},
}


def tandem_cycles(phase: str, *, collinear: bool = False) -> list[tuple[int, int]]:
    """Cycle pairs of a tandem phase; collinear pairs need a following cycle, so the last is left out."""
    _, _, first, last, shift, out = TANDEM[phase]
    pairs = [(c, c - shift) for c in range(first, last + 1) if c != out]
    return pairs[:-1] if collinear else pairs


def mission_cycles(mission: str, tag: str) -> list[int]:
    """Cycles of a tagged period that the product provides."""
    if tag in TANDEM:
        first, second = TANDEM[tag][:2]
        cycles = [p[0 if mission == first else 1] for p in tandem_cycles(tag)] if mission in (first, second) else []
    else:
        lo, hi = PERIODS["s6A" if mission == "s6Ah" else mission][tag]
        cycles = list(range(lo, hi + 1))
    return [c for c in cycles if c not in BAD_CYCLES.get(mission, ())]


def specs_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, s["earth_speed"], s["ground_speed"], s["inclination"], s["altitude"], s["passes"]) for m, s in SPECS.items()], "mission string, earth_speed double, ground_speed double, inclination double, altitude double, passes int")


def bad_cycles_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, c) for m, cs in BAD_CYCLES.items() for c in cs], "mission string, cycle int")


def tandem_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, TANDEM[p][0], a, TANDEM[p][1], b) for p in TANDEM for a, b in tandem_cycles(p)], "phase string, mission_a string, cycle_a int, mission_b string, cycle_b int")
