"""Query plans: fixture views, the query registry and the oracle SQL twins."""

from textsignal.plans.registry import ORACLE, QUERIES


def load_all() -> None:
    """Import every query module so that it registers itself."""
    from textsignal.plans import q_eval, q_extra, q_market, q_models, q_resample, q_research, q_text  # noqa: F401


__all__ = ["QUERIES", "ORACLE", "load_all"]
