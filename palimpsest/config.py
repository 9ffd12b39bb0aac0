"""Parameters of the operators, as plain values. No credentials and no addresses."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Query ids known as spam; some runs leave out the last two as well.
SPAM_QIDS = ("59769", "6060", "75200", "74351", "67599", "74238", "74207", "75100", "58130")
SPAM_QIDS_MORE = (*SPAM_QIDS, "62893", "75177")
#: Categories of time dependence.
CATEGORIES = ("time-independent", "timeliness", "event", "explicit-time")
#: Factors by category for documents with few crawl dates.
CATEGORY_FACTORS = {"time-independent": 1.20, "timeliness": 1.15, "event": 1.15, "explicit-time": 1.20}
#: Factor of a known pair by the similarity of the document's two texts, from the lower border.
SIMILARITY_FACTORS = ((1.0, 2.0), (0.95, 1.75), (0.90, 1.5), (0.85, 1.25), (0.80, 1.25))
#: Words left out of bags of words beside the stop words for French that ship with Spark.
EXTRA_STOP_WORDS = frozenset(
    "a au aux avec ce ces dans de des du en et il ils je j la le les leur lui ma mais me même mes moi mon ni notre nous on ou par pas pour "
    "qu que qui sa se si son sur ta te tes toi ton tu un une vos votre vous "
    "zero deux trois quatre cinq six sept huit neuf dix "
    "0 1 2 3 4 5 6 7 8 9 10 "
    "b c d e f g h i k l m n o p q r s t u v w x y z".split()
)


@dataclass(frozen=True)
class Bm25:
    """k1, b and k3 of BM25 and the depth of a run."""

    k1: float = 1.2
    b: float = 0.75
    k3: float = 8.0
    depth: int = 1000


@dataclass(frozen=True)
class Recency:
    """score + weight * tag / (1 + log1p(min(occurrences, clip)))."""

    weight: float = 1.0
    clip: int = 15


@dataclass(frozen=True)
class Snapshots:
    """An earlier snapshot with known judgments and a later one to rank."""

    earlier: str = "2023-02"
    later: str = "2023-03"
    months: tuple[str, ...] = field(default=("2022-10", "2022-11", "2022-12", "2023-01", "2023-02", "2023-03"))
