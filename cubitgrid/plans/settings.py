"""Settings of a scenario: allowed values, defaults, lengths, and the first stage that each one affects."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Centimetres of the presets, lengths in amot, and other constants of the rules.
PRESET_CM = {"naeh": 48.0, "moshe": 54.0, "chazonIsh": 57.6}
CITY_GAP = 70 + 2 / 3
MERGE_GAP = 141 + 1 / 3
TRIANGLE_SIDE = 2000
TRIANGLE_SPAN = 282 + 2 / 3
TECHUM = 2000
KESHET_MOUTH = 4000
KESHET_DEPTH = 2000
KESHET_WIDTH = 4000
REMA_EXTRA = 70 + 2 / 3
FOUR_AMOT = 4
DESCENT_LIMIT = 2000
MAX_AMAH_M = max(PRESET_CM.values()) / 100
MIN_BUILDINGS = 6
GRADIENT = 1 / 3.6
ROPE = 50
EDGE_MARGIN_M = 150.0
STRIP_M = 1500.0
MOST_EXTENT_M = 10_000.0
OBLONG = 0.95

#: Allowed values of each setting; a pair of numbers is a closed range.
ALLOWED: dict[str, tuple] = {
    "amahPreset": ("naeh", "moshe", "chazonIsh", "custom"),
    "customAmahCm": (30.0, 80.0),
    "triangleAbsorbsThird": (True, False),
    "triangleWideMiddle": ("merge", "noMerge"),
    "chazonIshStraightSide": (True, False),
    "keshetCondition": ("mouthAndDepth", "mouthOnly"),
    "keshetExclusion": ("entire", "past4000"),
    "remaExtra": (True, False),
    "fourAmotMode": ("each", "total"),
    "unequalLines": ("extend", "diagonal"),
    "havlaahWidth": ("chazonIsh", "magenAvraham", "rema"),
    "havlaahLength": ("parallel", "fullWidth"),
    "havlaahEruvStartCity": (True, False),
    "eruvCityTechum": (True, False),
    "fetchRadiusM": (1000.0, 6000.0),
    "language": ("en", "he"),
}
NEVER = 99
#: The first stage that a change of each setting affects.
FIRST_STAGE = {
    "amahPreset": 2, "customAmahCm": 2, "triangleAbsorbsThird": 3, "triangleWideMiddle": 3, "chazonIshStraightSide": 4, "keshetCondition": 4, "keshetExclusion": 4, "remaExtra": 4,
    "fourAmotMode": 5, "unequalLines": 6, "havlaahWidth": 6, "havlaahLength": 6, "havlaahEruvStartCity": 8, "eruvCityTechum": 7, "fetchRadiusM": 1, "language": NEVER,
}


@dataclass(frozen=True)
class Settings:
    amahPreset: str = "naeh"
    customAmahCm: float = 48.0
    triangleAbsorbsThird: bool = True
    triangleWideMiddle: str = "noMerge"
    chazonIshStraightSide: bool = False
    keshetCondition: str = "mouthAndDepth"
    keshetExclusion: str = "past4000"
    remaExtra: bool = False
    fourAmotMode: str = "each"
    unequalLines: str = "extend"
    havlaahWidth: str = "magenAvraham"
    havlaahLength: str = "parallel"
    havlaahEruvStartCity: bool = True
    eruvCityTechum: bool = True
    fetchRadiusM: float = 3000.0
    language: str = "en"

    @property
    def amah_m(self) -> float:
        return PRESET_CM.get(self.amahPreset, self.customAmahCm) / 100

    def mm(self, amot: float) -> int:
        """A length in whole millimetres; exact for the three presets."""
        return round(amot * self.amah_m * 1000)

    @classmethod
    def load(cls, given: dict) -> Settings:
        """Defaults, overridden by the valid entries of `given`; others are left out one by one."""
        return cls(**{k: float(v) if k in ("customAmahCm", "fetchRadiusM") else v for k, v in given.items() if valid(k, v)})

    def first_stage(self, new: Settings) -> int:
        """The first stage to run again when these settings become `new`; NEVER if none."""
        return min((FIRST_STAGE[f.name] for f in fields(self) if getattr(self, f.name) != getattr(new, f.name)), default=NEVER)

    def read_by(self, stage: int) -> tuple:
        """What a stage and those before it depend on: the key under which its result may be kept."""
        return tuple((k, v) for k, v in asdict(self).items() if FIRST_STAGE[k] <= stage)


def valid(key: str, value) -> bool:
    allowed = ALLOWED.get(key)
    if allowed is None:
        return False
    if isinstance(allowed[0], float):
        return isinstance(value, int | float) and not isinstance(value, bool) and allowed[0] <= value <= allowed[1]
    return isinstance(value, type(allowed[0])) and value in allowed


def valid_column(key: str, value: Column) -> Column:
    """valid() for a column of text: false where it is null or not an allowed value."""
    allowed = ALLOWED[key]
    if isinstance(allowed[0], float):
        return F.coalesce(value.try_cast("double").between(*allowed), F.lit(False))
    return F.coalesce(value.isin([str(a).lower() if isinstance(a, bool) else a for a in allowed]), F.lit(False))


def from_json(rows: DataFrame, column: str) -> DataFrame:
    """Settings of each row from a column of JSON text, entry by entry: invalid or missing ones get their default."""
    given = F.from_json(column, "map<string,string>")
    default = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in asdict(Settings()).items()}
    out = rows
    for k in ALLOWED:
        value = F.try_element_at(given, F.lit(k))
        out = out.withColumn(k, F.when(valid_column(k, value), value).otherwise(default[k]))
    return out


def to_json(rows: DataFrame, column: str) -> DataFrame:
    """rows with their settings, columns of these names, as JSON text: what from_json() reads."""
    typed = {k: "double" if isinstance(a[0], float) else "boolean" if isinstance(a[0], bool) else "string" for k, a in ALLOWED.items()}
    return rows.withColumn(column, F.to_json(F.struct(*[F.col(k).cast(t).alias(k) for k, t in typed.items() if k in rows.columns]))).drop(*typed)


def shown(key: str, value: Column) -> Column:
    """A setting's value for a report: yes or no, centimetres, kilometres, or the value itself."""
    if key == "customAmahCm":
        return F.format_string("%s cm", value.cast("string"))
    if key == "fetchRadiusM":
        return F.format_string("%.1f km", value.cast("double") / 1000)
    return F.when(value.cast("boolean"), "Yes").otherwise("No") if isinstance(ALLOWED[key][0], bool) else value.cast("string")


def report_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, setting, value): a row for each setting of each row, as reports show it."""
    each = F.array(*[F.struct(F.lit(k).alias("setting"), shown(k, F.col(k)).alias("value")) for k in ALLOWED])
    return rows.select(*keys, F.explode(each).alias("s")).select(*keys, "s.*")


def first_stage_rows(changes: DataFrame) -> DataFrame:
    """(change_id, stage) of rows (change_id, setting, old, new): the smallest first stage among what differs."""
    steps = F.create_map(*[F.lit(x) for kv in FIRST_STAGE.items() for x in kv])
    stage = F.when(~F.col("old").eqNullSafe(F.col("new")), F.try_element_at(steps, F.col("setting"))).otherwise(NEVER)
    return changes.groupBy("change_id").agg(F.min(stage).alias("stage"))
