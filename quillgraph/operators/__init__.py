"""Operators on triples, ragged matrices, scores and query graphs."""


from typing import Protocol

from pyspark.sql import DataFrame


class Reasoner(Protocol):
    """What a reasoner offers: a predictor, a loss of scored rows, and scores of all entities."""

    def set_predictor(self, predictor) -> None: ...

    def train_loss(self, rows: DataFrame) -> DataFrame: ...

    def all_entity_scores(self, query, instances: DataFrame) -> DataFrame: ...


def reasoner(name: str):
    """The scoring function of a reasoner by name: cqd (beam search) or lmpnn (message passing)."""
    from . import beam, message

    known = {"cqd": beam.scores, "lmpnn": message.scores}
    if name not in known:
        raise ValueError(f"no reasoner {name!r}")
    return known[name]
