"""Models: time-ordered folds, out-of-fold predictions, an honest baseline next to every metric."""
