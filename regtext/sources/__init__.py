"""Note and registry scans (S1-S4) and result sinks."""
