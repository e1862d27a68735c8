"""Export jobs: any result DataFrame written as text, JSON, XML, CSV or chart series."""
