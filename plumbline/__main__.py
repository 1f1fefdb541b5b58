from plumbline.cli import main

raise SystemExit(main())
