"""Fixed dimension tables: presets, tokenizer profiles, prices, stop words, code keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name -> (target compression, dedup threshold, accuracy floor). The floor is accepted and has no effect.
PRESETS = {"conservative": (0.40, 0.92, 0.98), "balanced": (0.70, 0.85, 0.95), "aggressive": (0.85, 0.75, 0.90)}
# Characters per token of each profile.
PROFILES = {"default": 4.0, "gpt-4": 4.0, "gpt-4o": 4.0, "gpt-3.5": 4.0, "claude": 3.8, "gemini": 4.0}
# Tokens of each profile's context window, dollars for a million input tokens, and budgets that are often asked for.
CONTEXT_WINDOWS = {"default": 128_000, "gpt-4": 8_192, "gpt-4o": 128_000, "gpt-3.5": 16_385, "claude": 200_000, "gemini": 1_000_000}
PRICES = {"default": 3.0, "gpt-4": 30.0, "gpt-4o": 2.5, "gpt-3.5": 0.5, "claude": 3.0, "gemini": 1.25}
COMMON_BUDGETS = {"8K": 8_000, "32K": 32_000, "128K": 128_000, "200K": 200_000}
# Filler patterns, matched at a chunk's beginning without regard to case.
FILLER_PATTERNS = (
    r"^\s*#.*$", r"^\s*//.*$", r"^\s*(import|from)\s+\S+", r"^\s*(using|package)\s+\S+",
    r"^\s*\{?\s*\}?\s*$", r"^\s*(pass|continue|break)\s*$", r"^\s*(INFO|DEBUG)\b.*heartbeat.*$",
)
# Words that are no references.
CODE_KEYWORDS = (
    "def class return if elif else for while try except finally with as import from pass break continue raise yield lambda "
    "global nonlocal assert del in is not and or None True False self cls async await"
).split()
# File endings of a repository scan and folders that it leaves out.
CODE_ENDINGS = ("py", "js", "jsx", "ts", "tsx", "java", "go", "rb", "php", "c", "h", "cpp", "hpp", "cs", "rs", "swift", "kt")
PRUNED_FOLDERS = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next")
# The public English stop-word list of the Glasgow information-retrieval group.
STOP_WORDS = (
    "a about above across after afterwards again against all almost alone along already also although always am among amongst "
    "amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back be became because become "
    "becomes becoming been before beforehand behind being below beside besides between beyond bill both bottom but by call can "
    "cannot cant co con could couldnt cry de describe detail do done down due during each eg eight either eleven else elsewhere "
    "empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire first five for former "
    "formerly forty found four from front full further get give go had has hasnt have he hence her here hereafter hereby herein "
    "hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter "
    "latterly least less ltd made many may me meanwhile might mill mine more moreover most mostly move much must my myself name "
    "namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off often on once one only onto "
    "or other others otherwise our ours ourselves out over own part per perhaps please put rather re same see seem seemed seeming "
    "seems serious several she should show side since sincere six sixty so some somehow someone something sometime sometimes "
    "somewhere still such system take ten than that the their them themselves then thence there thereafter thereby therefore therein "
    "thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards "
    "twelve twenty two un under until up upon us very via was we well were what whatever when whence whenever where whereafter "
    "whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will with within "
    "without would yet you your yours yourself yourselves"
).split()


def preset_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *v) for n, v in PRESETS.items()], "preset string, target double, dedup_threshold double, accuracy_floor double")


def model_table(spark: SparkSession) -> DataFrame:
    """(model, window, price): six rows."""
    return spark.createDataFrame([(m, CONTEXT_WINDOWS[m], PRICES[m]) for m in PROFILES], "model string, window int, price double")


def preset(name: str) -> tuple[float, float, float]:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(PRESETS)}")
    return PRESETS[name]
