"""The runs: initial training, active learning, experiments."""
