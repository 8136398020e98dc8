"""Multi-operator jobs: retraining and its run log."""
