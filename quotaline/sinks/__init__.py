"""Writers: clustered tables, serving snapshots, application tables and CSV reports."""
