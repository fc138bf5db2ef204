"""Query registry: named plans over the driver tables plus their oracle SQL."""


def all_queries():
    """Import every query module so that all queries are registered."""
    from . import q_history, q_matches, q_players, q_quality, q_sources, q_standings, q_web  # noqa: F401
    from .registry import QUERIES
    return QUERIES
