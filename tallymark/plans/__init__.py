"""Multi-step plans: the full reconciliation and transform chains."""
