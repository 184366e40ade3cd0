"""Names and schema ids; nothing else in the package spells them out."""

TOOL, VERSION = "hunksieve", "0.1.0"
#: Comment directives start with this, in any case.
DIRECTIVE = "hunksieve:"
CONFIG_FILE = "hunksieve.toml"
CHECK_SCHEMA = "hunksieve.check.v1"
BASELINE_SCHEMA = "hunksieve.false_positive_baseline.v1"
TREND_SCHEMA = "hunksieve.trend_history.v1"
SENSOR_SCHEMA = "sensor.report.v1"
MAX_U32 = 4294967295
