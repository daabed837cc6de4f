"""Turn tables of personal notes into training and inference data for persona models."""
