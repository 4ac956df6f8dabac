"""Double-typed output columns of the registered queries (generated from
their Spark schemas; checked by tests/test_oracle.py)."""

FLOAT_COLS = {
    'bag_networks': ['loss', 'accuracy', 'precision', 'recall', 'f1score'],
    'batch_gradients': ['loss', 'norm'],
    'centroid_scores': ['prob'],
    'class_epoch_pivot': ['epoch_0', 'epoch_1', 'epoch_2', 'epoch_3'],
    'class_size_quantiles': ['mean', 'min', 'q25', 'median', 'q75', 'max'],
    'early_stop': ['best_loss'],
    'evaluator_state': ['accuracy', 'loss', 'precision', 'recall', 'f1score'],
    'epoch_best': ['best_loss', 'best_acc'],
    'epoch_summary': ['train_loss', 'train_accuracy', 'train_precision', 'train_recall', 'train_f1score', 'valid_loss', 'valid_accuracy', 'valid_precision', 'valid_recall', 'valid_f1score'],
    'loss_ce': ['loss'],
    'loss_fce': ['loss'],
    'loss_ice': ['loss'],
    'loss_reductions': ['loss'],
    'loss_weighted': ['loss'],
    'macro_metrics': ['accuracy', 'precision', 'recall', 'f1score'],
    'model_metrics': ['accuracy', 'loss', 'precision', 'recall', 'f1score'],
    'one_hot': ['t'],
    'per_class_metrics': ['precision', 'recall', 'f1score'],
    'subset_metrics': ['accuracy', 'precision', 'recall', 'f1score'],
    'subset_per_type': ['accuracy', 'precision', 'recall', 'f1score'],
    'subset_top_acc': ['score'],
    'subset_top_f1': ['score'],
    'subset_top_weighted': ['score'],
    'test_summary': ['test_loss', 'accuracy', 'precision', 'recall', 'f1score'],
    'text_bagging_summary': ['accuracy', 'precision', 'recall', 'f1score'],
    'train_head': ['loss', 'accuracy', 'precision', 'recall', 'f1score'],
}
