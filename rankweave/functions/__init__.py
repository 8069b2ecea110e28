"""Column functions and the few Arrow helpers the operators share."""
