"""Registered queries by area; importing this package fills the registry."""

from crosstide.plans import audit, comparison, control, date_features, entity_features, evaluation, fitting, labels, streams, tables  # noqa: F401
