"""The default ontology, as data. Every operator takes it as a parameter, so another domain brings its own."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: themes, keywords and word lists that results depend on ---

THEME_KEYWORDS: dict[str, list[str]] = {
    "INFLATION": ["inflation", "prices", "price stability", "disinflation", "pce", "cpi"],
    "LABOR_MARKETS": ["labor market", "labor markets", "employment", "jobs", "job growth", "wages", "unemployment", "payroll"],
    "GROWTH_OUTLOOK": ["growth", "gdp", "activity", "recession", "demand", "output"],
    "POLICY_STANCE": ["policy", "rates", "restrictive", "accommodative", "federal funds", "tightening", "easing"],
    "FINANCIAL_CONDITIONS": ["financial conditions", "credit", "lending", "yields", "market functioning"],
    "HOUSING": ["housing", "shelter", "rent", "home prices", "real estate"],
    "CONSUMER_SPENDING": ["consumer", "consumption", "spending", "household demand"],
    "GLOBAL_FACTORS": ["global", "international", "trade", "china", "europe", "geopolitical"],
    "BALANCE_SHEET": ["balance sheet", "qt", "quantitative tightening", "asset holdings"],
    "FINANCIAL_STABILITY": ["financial stability", "banking", "liquidity", "stress", "capital"],
}

HEDGES = ["may", "might", "could", "appears", "appear", "seems", "seem", "somewhat", "generally", "largely", "possibly", "potentially", "uncertain", "uncertainty", "perhaps"]

LOW_SIGNAL = ["federal reserve", "board of governors", "thank you", "good morning", "good afternoon", "good evening", "press release"]

STANCE_UP = ["progress", "moderating", "moderation", "improving", "improvement", "declined", "declining", "balanced"]
STANCE_DOWN = ["elevated", "persistent", "concern", "concerning", "strong", "resilient", "upside", "inflationary", "tight", "restrictive"]
TRAJECTORY_UP = ["improving", "moderating", "slowing", "cooling", "declining", "easing"]
TRAJECTORY_DOWN = ["worsening", "accelerating", "rising", "elevated", "persistent", "firming"]

TONE_CAUTIOUS = ["uncertain", "careful", "cautious"]
TONE_CONFIDENT = ["confident", "strong", "resilient"]

STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "their",
    "this", "to", "was", "we", "will", "with", "would", "our", "they", "i", "you", "he", "she", "them",
]

STANCES = ["very_optimistic", "optimistic", "neutral", "concerned", "very_concerned"]
TRAJECTORIES = ["improving_rapidly", "improving", "stable", "stable_negative", "worsening"]
HEDGING_LEVELS = ["none", "light", "moderate", "heavy"]
UNCERTAINTIES = ["low", "medium", "high"]

QUESTION_HINTS: dict[str, list[str]] = {
    "INFLATION": ["inflation", "price", "prices", "disinflation", "pce", "cpi"],
    "LABOR_MARKETS": ["labor", "labour", "jobs", "employment", "wages", "unemployment"],
    "GROWTH_OUTLOOK": ["growth", "gdp", "recession", "activity", "demand"],
    "POLICY_STANCE": ["policy", "rates", "restrictive", "tightening", "easing", "cuts", "hikes"],
    "FINANCIAL_CONDITIONS": ["financial conditions", "credit", "lending", "yields"],
    "HOUSING": ["housing", "shelter", "rent", "real estate"],
}

DRAFT_NOTE = "Heuristic extraction used; treat outputs as draft quality."
NO_THEME_NOTE = "No themes met the heuristic inclusion threshold."

# --- end of fixed values ---


@dataclass(frozen=True)
class Ontology:
    """What the fingerprint operators look for. Small by nature: it travels in the plan as literals."""

    themes: dict[str, list[str]] = field(default_factory=lambda: THEME_KEYWORDS)
    hedges: list[str] = field(default_factory=lambda: HEDGES)
    low_signal: list[str] = field(default_factory=lambda: LOW_SIGNAL)
    stance_up: list[str] = field(default_factory=lambda: STANCE_UP)
    stance_down: list[str] = field(default_factory=lambda: STANCE_DOWN)
    trajectory_up: list[str] = field(default_factory=lambda: TRAJECTORY_UP)
    trajectory_down: list[str] = field(default_factory=lambda: TRAJECTORY_DOWN)
    cautious: list[str] = field(default_factory=lambda: TONE_CAUTIOUS)
    confident: list[str] = field(default_factory=lambda: TONE_CONFIDENT)
    stopwords: list[str] = field(default_factory=lambda: STOPWORDS)

    def ordinal(self, theme: str) -> int:
        return list(self.themes).index(theme)


DEFAULT = Ontology()
