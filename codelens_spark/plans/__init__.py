"""Plan building blocks shared by the operators: scans, interval lookups, skew-safe joins, staging."""
