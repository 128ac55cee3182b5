"""Constants and scalar functions that the operators share."""
