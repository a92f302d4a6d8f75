"""Physical-layout helpers shared by the operators: hot keys, bounded broadcasts, staging."""
