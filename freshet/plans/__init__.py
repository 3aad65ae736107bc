"""Driver-side orchestration: models, training, comparison, registered queries."""
