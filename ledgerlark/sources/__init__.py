"""Sources and sinks: question files and tables, predictions, raw filings, results."""
