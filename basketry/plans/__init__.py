"""Plans: compositions of operators (dashboard metrics, segmentation model, query catalog)."""
