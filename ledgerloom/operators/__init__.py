"""Set-at-a-time operators over documents, extractions, invoices and jobs."""
