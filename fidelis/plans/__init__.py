"""Registered queries over the driver's tables; importing this package fills the registry."""

from fidelis.plans import q_dependency, q_latent, q_marginal, q_measurement, q_prep, q_privacy, q_ranking, q_report, q_rules, q_stream, q_tables  # noqa: F401
from fidelis.plans.registry import ORACLES, QUERIES  # noqa: F401
