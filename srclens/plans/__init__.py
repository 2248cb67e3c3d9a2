"""End-to-end plans: the analysis pipeline and the registered queries."""
